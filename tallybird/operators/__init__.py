"""Analytics operators: DataFrames in, DataFrame out."""
