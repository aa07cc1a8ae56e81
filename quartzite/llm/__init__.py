"""Operators of a training-data pipeline: deduplication, search, tokenising, extraction, mixing.

Nothing outside this subpackage imports it.
"""
