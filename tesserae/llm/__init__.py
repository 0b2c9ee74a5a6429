"""Operators a large training-data pipeline needs, as Spark jobs.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
