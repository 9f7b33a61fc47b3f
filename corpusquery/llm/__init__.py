"""Operators for building training data: filters, deduplication, archives and tokens."""
