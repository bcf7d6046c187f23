"""tessera: relational, vector, full-text, spatial and time-series analytics on Spark DataFrames."""

__version__ = "0.1.0"
