"""Operators and pipeline stages for large text corpora (training data).

Nothing outside this package imports it.
"""
