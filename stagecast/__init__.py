"""stagecast: revisioned sensor time series on Spark DataFrames."""

__version__ = "0.1.0"
