"""Relational, array and search operators over DataFrames."""
