"""quillbook: statement and document analytics expressed as Spark DataFrame jobs."""
