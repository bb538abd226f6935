"""Operators for training-data corpora: sharding, filtering, deduplication, extraction, tokens."""
