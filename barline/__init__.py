"""Panel analytics on Spark: tables keyed by (symbol, date) in, lazy DataFrames out."""
