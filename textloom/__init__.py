"""textloom: knowledge-text analytics on Spark DataFrames."""
