"""Traceability and change-impact analytics on Spark DataFrames."""
