"""Analyses: DataFrames in, DataFrames out."""
