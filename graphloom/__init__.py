"""Federated property-graph analytics on Spark DataFrames."""
