"""Operators of a training-data pipeline.  Nothing else in memspark imports this package."""
