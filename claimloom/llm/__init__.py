"""Operators for large text corpora used as training data. Nothing else in the library imports them."""
