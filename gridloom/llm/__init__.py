"""Operators for training text and ranking data. Nothing outside this package imports it."""
