"""Readers, statement layouts, routing and sinks."""
