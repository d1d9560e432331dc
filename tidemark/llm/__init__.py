"""Operators for large training-data pipelines.

Nothing outside this package imports it; ``queries.py`` holds the thin
contract queries that ``__spark_entry__`` registers when the package exists.
"""
