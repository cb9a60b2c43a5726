"""Part of the sequence-mapping library."""
