"""Structured Streaming ingest and live counters."""
