"""Point-cloud plane analytics expressed as Spark DataFrame queries."""
