"""Operators for preparing training data: filters, deduplication, scoring, packing."""
