"""Dependency-graph analytics on PySpark: typed nodes and edges as DataFrames."""
