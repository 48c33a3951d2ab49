"""Operators for preparing training text at scale: filters, deduplication, mixing, encoding.

Nothing outside this subpackage imports it.
"""
