"""quillspark: retrieval, relational and time-interval analytics as Spark jobs."""
