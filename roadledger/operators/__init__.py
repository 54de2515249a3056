"""DataFrame operators: every function takes DataFrames and column names, returns a DataFrame."""
