"""docflow: document-structure analytics on Spark DataFrames."""
