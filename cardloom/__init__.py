"""Card and document text analytics as composable Spark DataFrame jobs."""
