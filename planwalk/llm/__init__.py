"""Operators for training-data pipelines over text tables; nothing outside this package imports it."""
