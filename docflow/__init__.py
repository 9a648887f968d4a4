"""docflow: document processing and retrieval on Spark DataFrames."""
