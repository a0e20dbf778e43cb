"""Operators of a training-data pipeline: mixing, deduplication, filters, archives, tokens.

Nothing else in the library imports this subpackage.
"""
