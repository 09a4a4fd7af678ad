"""Step-level reasoning data as Spark DataFrame jobs."""
