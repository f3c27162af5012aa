"""larkspur: retrieval, log and corpus analytics expressed as Spark DataFrame plans."""
