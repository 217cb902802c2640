"""Operators of a training-data pipeline and their named queries (`queries.load()`)."""
