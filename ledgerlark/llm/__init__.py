"""Operators of a training-data pipeline: each module has one operator and its thin query."""
