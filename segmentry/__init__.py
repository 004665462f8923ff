"""Segmented-media manifest analytics on Spark DataFrames, SQL and Structured Streaming."""
