"""Mission analytics as PySpark DataFrame, SQL and Structured Streaming jobs."""
