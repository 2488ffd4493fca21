"""Column expressions: every per-row rule, as native Spark expressions."""
