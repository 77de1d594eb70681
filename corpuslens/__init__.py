"""Evidence retrieval, decision support and corpus preparation as Spark DataFrame operators."""
