"""Operators for preparing training data: filters, deduplication, packing and token files."""
