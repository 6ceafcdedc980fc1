"""Operators of a training-data pipeline, each in a module of its own with its query and SQL in `registered`."""
