"""DataFrame operators. Each takes and returns lazily evaluated DataFrames."""
