"""Column expressions (native Spark functions only) and SQL twins."""
