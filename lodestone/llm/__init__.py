"""Operators for building training data from very large text collections.

Nothing outside this folder imports it, so it can be shipped or left out on its own.
"""
