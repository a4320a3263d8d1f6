"""tidegauge: time-based aggregation and corpus processing as PySpark DataFrames."""

__version__ = "0.1.0"
