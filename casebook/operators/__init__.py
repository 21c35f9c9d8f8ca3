"""Operators over events: DataFrames in, DataFrames out."""
