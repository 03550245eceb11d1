"""Operators for preparing training data: filters, dedup, mixing, packing and storage."""
