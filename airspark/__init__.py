"""Spark-native analytics for hourly air-quality series of many stations."""

__version__ = "0.1.0"
