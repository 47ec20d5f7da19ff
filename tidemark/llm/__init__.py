"""Operators for building training data from text at scale; nothing else in the library imports this package."""
