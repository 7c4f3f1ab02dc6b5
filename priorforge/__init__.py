"""priorforge: prior-guided tabular learning and corpus preparation on Spark DataFrames."""
