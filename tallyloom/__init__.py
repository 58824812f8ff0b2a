"""Click-log and regional analytics as Spark DataFrame operators and jobs."""
