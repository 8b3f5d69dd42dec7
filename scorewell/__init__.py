"""Survey and assessment analytics expressed as Spark DataFrame plans."""
