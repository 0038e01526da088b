"""Contest-outcome analytics as Spark DataFrame jobs."""
