"""Operators for preparing text corpora at large scale; nothing else in the package imports them."""
