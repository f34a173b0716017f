"""Structured Streaming jobs (continuous ingest into the store)."""
