"""Transaction-graph privacy analytics as Spark jobs."""
