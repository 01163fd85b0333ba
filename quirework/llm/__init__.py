"""Operators for training-data text. Nothing else in the package imports this."""
