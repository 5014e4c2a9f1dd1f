"""strandline: lossless-encoding analytics expressed as Spark DataFrame plans."""
