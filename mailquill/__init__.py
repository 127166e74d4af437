"""Alert-mail digests as Spark DataFrame jobs."""
