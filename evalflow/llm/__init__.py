"""Operators for preparing training data: each reads and returns DataFrames and scales with the cluster."""
