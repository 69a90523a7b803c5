"""Track and identity analytics as Spark jobs."""
