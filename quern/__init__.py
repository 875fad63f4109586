"""quern: a Spark-first full-text search and retrieval-analytics engine."""
