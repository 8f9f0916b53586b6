"""Triangle counting and stream statistics as Spark DataFrame jobs."""
