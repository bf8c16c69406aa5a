"""Panel and bar analytics expressed as Spark DataFrame plans."""
