"""SQL text to DataFrames."""
