"""Operators that prepare training data from a code index."""
