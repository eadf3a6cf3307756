"""Expressions over one row: distribution functions and array helpers."""
