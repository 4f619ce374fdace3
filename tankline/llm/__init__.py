"""Operators for pipelines of training data; nothing else in the library imports them."""
