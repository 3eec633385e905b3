"""tideline: analytics over many time series at once, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
