"""Operators of a training-data pipeline: ten Spark jobs over documents, pages and vectors.

Nothing else in the package imports this subpackage.
"""
