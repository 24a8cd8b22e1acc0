"""Operators for building training data from a corpus; nothing outside imports them."""
