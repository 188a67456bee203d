"""Operators for preparing training data: search, deduplication, filters, sharding, tokens.

Nothing else in the library imports this subpackage.
"""
