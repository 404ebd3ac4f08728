"""Usage analytics for coding agents as Spark jobs."""
