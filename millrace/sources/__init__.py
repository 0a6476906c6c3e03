"""Readers. All return lazy DataFrames."""
