"""Batch and shared operators on DataFrames."""
