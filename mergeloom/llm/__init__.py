"""Operators for training data on keys and texts. Nothing else in the library imports this."""
