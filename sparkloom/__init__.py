"""Spark-native document retrieval, text analytics and evaluation engine."""

__version__ = "0.1.0"
