"""Search-result and page analytics as Spark jobs."""
