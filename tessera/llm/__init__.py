"""Operators for building training data: an optional part that nothing else in the library imports."""
