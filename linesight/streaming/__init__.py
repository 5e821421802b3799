"""Structured Streaming entry points (micro-batches run the batch plans)."""
