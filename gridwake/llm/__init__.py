"""Operators for text corpora and training sets; nothing outside this package imports it."""
