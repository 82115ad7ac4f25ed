"""Vector-retrieval analytics and data processing on Spark DataFrames."""
