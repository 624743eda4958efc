"""Retail merchandise-flow analytics on Spark DataFrames."""
