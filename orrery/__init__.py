"""Code-graph and corpus analytics on Spark: relations in, lazy DataFrames out."""
