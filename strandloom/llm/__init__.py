"""Operators for training-data corpora; self-contained, nothing else in the library imports this package."""
