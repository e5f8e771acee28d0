"""Operators of a training-data pipeline, as Spark jobs over a ``documents`` table.

Nothing else in the library imports this package.
"""
