"""Semantic-graph analytics on Spark DataFrames."""
