"""Customer-retention analytics expressed as Spark DataFrame and MLlib jobs."""
