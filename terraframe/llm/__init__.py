"""Operators for preparing training data: mixing, deduplication, packing, filters, search.

Nothing outside this package imports it.
"""
