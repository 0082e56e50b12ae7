"""Spark-first analytics for versioned, geographically partitioned data."""
