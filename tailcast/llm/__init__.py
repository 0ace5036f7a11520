"""Operators of a training-data pipeline: counting, archives, extraction, filtering, deduplication, mixing, sharding."""
