"""sedge: a Spark-first engine for corpus, evaluation and ordered-stream analytics."""
