"""Operators of a training-data pipeline: cleaning, deduplication, search, mixing and packing."""
