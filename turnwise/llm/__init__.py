"""Operators for preparing training data: search, tokenising, filters, near-duplicates, mixing.

Nothing outside this folder imports it; the queries that use it are in ``queries.py``.
"""
