"""Waymark: journey-network analytics on Spark DataFrames."""
