"""Relational and user-function operators on DataFrames."""
