"""Spark-native analytics over long tables of wearable-sensor epochs."""

__version__ = "0.1.0"
