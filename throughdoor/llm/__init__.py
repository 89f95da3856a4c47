"""Operators for preparing text corpora: scoring, deduplication, mixing, output.

Nothing outside this package imports it.
"""
