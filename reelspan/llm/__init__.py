"""Operators for training data. The rest of the library does not import this package."""
