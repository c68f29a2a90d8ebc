"""Structured Streaming forms of time buckets."""
