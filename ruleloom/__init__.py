"""Detection rules and corpus preparation as Spark jobs."""
