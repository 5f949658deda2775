"""Spark-native analytics for annotated multi-party conversations."""

__version__ = "0.1.0"
