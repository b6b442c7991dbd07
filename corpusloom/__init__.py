"""Document-retrieval and corpus-preparation operators expressed as PySpark DataFrame jobs."""
