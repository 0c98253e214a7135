"""Corpus operators for training data: dedup, scoring, mixing, packing, sharding, search."""
