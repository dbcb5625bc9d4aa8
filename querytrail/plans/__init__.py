"""The analysis jobs, each a function from DataFrames to a DataFrame."""
