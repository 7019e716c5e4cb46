"""Per-cell network analytics expressed as Spark DataFrame operations."""
