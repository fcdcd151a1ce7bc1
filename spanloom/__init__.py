"""Layered, position-keyed text annotation and corpus preparation on Spark DataFrames."""
