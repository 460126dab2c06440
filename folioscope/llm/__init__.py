"""Operators for preparing training data: one module for each operator, general interfaces, Spark-first.

Nothing outside this folder imports it.  Queries and their SQL are in ``queries.py``.
"""
