"""Operators for training-data pipelines over texts, vectors and baskets.

Nothing outside this subpackage imports it.
"""
