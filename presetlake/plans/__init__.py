"""Requests to lazy DataFrames."""
