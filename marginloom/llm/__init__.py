"""Operators of a training-data pipeline: deduplication, quality, packing, tokens, archives, privacy, search."""
