"""korrel: a Spark-first engine for file indexing, hybrid file search and data preparation."""
