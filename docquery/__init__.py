"""docquery: document retrieval and analytics expressed as Spark plans."""
