"""Operators on series tables, observations, predictions and grids."""
