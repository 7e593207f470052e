"""Compositions of operators: ingest, month close, verification, query registry."""
