"""Table profiling, data quality, personal-data screening and drift as Spark DataFrame jobs."""
