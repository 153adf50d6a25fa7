"""Road and climate accessibility analytics expressed as Spark DataFrame plans."""
