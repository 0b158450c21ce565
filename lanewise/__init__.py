"""Route-quality analytics and corpus preparation as plain Spark DataFrame jobs."""
