"""Model training on DataFrames with MLlib, and gang-scheduled per-rank functions."""
