"""Operators for large-scale training-data preparation, each over whole tables."""
