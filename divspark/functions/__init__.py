"""Column expressions (built-in Spark functions only)."""
