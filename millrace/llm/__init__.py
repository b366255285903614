"""Operators that prepare large text corpora for training. Nothing outside this package imports it."""
