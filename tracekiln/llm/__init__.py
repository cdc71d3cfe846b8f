"""Operators for training-data pipelines.

One module per operator; ``queries`` registers the ``opN_*`` queries and their
DuckDB statements.  Nothing outside this package imports it.
"""
