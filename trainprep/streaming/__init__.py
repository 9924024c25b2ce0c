"""Structured Streaming jobs: incremental shard preparation and early stopping."""
