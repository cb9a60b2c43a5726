"""Whole queries over the operators."""
