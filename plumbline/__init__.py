"""Plumbline: claim-verification analytics and corpus preparation on Spark DataFrames."""
