"""Document-retrieval, evaluation and corpus-preparation analytics on Spark."""
