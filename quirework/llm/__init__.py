"""Operators for training-data work on text. Nothing outside this package imports it."""
