"""Table profiling, cleaning and business analysis as Spark DataFrame jobs."""
