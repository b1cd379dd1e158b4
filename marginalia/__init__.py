"""Text retrieval and analytics on Spark DataFrames."""
