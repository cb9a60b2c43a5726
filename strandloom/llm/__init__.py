"""Training-data operators: media, deduplication, scoring, filtering, mixing."""
