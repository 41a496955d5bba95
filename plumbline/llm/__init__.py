"""Operators for preparing training data: scoring, filtering, sharding, de-duplication, packing and token files."""
