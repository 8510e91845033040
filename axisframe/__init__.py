"""A Spark-native engine for data with named, typed dimensions."""

__version__ = "0.1.0"
