"""Operators for large text corpora: cleaning, deduplication, scoring, mixing, formatting and sharding.

Nothing outside this package imports it.
"""
