"""Operators that prepare large text corpora and vector sets for training.

Nothing outside this subpackage imports it.
"""
