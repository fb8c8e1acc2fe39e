"""Market microstructure analytics expressed as Spark DataFrame jobs."""
