"""Document retrieval and question answering as PySpark DataFrame jobs."""
