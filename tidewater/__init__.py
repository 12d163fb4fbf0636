"""Market and event time-series analytics expressed as Spark DataFrame jobs."""
