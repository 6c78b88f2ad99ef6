"""Operators for training-data work. Nothing outside this package imports it."""
