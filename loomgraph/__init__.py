"""Spark-native pair, vector and graph analytics."""

__version__ = "0.1.0"
