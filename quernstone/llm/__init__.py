"""Corpus operators for training data; nothing outside this package imports it."""
