"""pagemill: document-text analytics and training-data preparation as Spark DataFrame jobs."""
