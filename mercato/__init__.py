"""Price-catalog analytics as Spark DataFrame jobs."""
