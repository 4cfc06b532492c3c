"""Operators of a training-data pipeline: one module for each, with its query and SQL beside it."""
