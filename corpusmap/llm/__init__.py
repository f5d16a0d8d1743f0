"""Operators of a training-data pipeline: scoring, scanning, deduplication, packing."""
