"""Operators of a training-data pipeline: filters, deduplication, scoring, mixing and tokenisation.

Nothing outside this subpackage imports it.
"""
