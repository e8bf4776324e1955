"""Spark-native analytics over gridded daily archives."""

__version__ = "0.1.0"
