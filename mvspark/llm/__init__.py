"""Operators for training-data pipelines: filters, deduplication, mixing and token output."""
