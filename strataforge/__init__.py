"""Document ingestion, hybrid retrieval and corpus processing on Spark DataFrames."""
