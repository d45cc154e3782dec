"""Operators of a training-data pipeline: archives, search, deduplication, selection, mixing, sharding, packing, token files."""
