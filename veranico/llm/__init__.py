"""Operators for text corpora and free-entered records; nothing outside this package imports it."""
