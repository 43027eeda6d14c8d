"""Document retrieval and corpus work as Spark jobs."""
