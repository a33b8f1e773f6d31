"""Operators on nodes and edges: each takes DataFrames and gives a lazy DataFrame."""
