"""Spark-native document retrieval and training-data operators."""

__version__ = "0.1.0"
