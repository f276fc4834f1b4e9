"""Message and corpus analytics expressed as Spark DataFrame jobs."""
