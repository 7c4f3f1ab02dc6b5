"""Dataset, split, prior, metric, result, scoring and selection operators on DataFrames."""
