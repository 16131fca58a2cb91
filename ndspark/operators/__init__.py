"""Arrays and groups as DataFrames."""
