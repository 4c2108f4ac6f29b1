"""Document-governance analytics expressed as Spark DataFrame plans."""
