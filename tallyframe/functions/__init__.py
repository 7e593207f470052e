"""Column-level building blocks (no Python UDFs)."""
