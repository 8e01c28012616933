"""Typed transforms from DataFrames to DataFrames."""
