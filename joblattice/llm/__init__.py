"""Operators that prepare text for model training: dedup, sharding, scoring, packing."""
