"""Head-to-head rating, ranking and prediction analytics as Spark DataFrame jobs."""
