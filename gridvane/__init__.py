"""Vector search, graph-profile analytics and layout planning on Spark DataFrames."""
