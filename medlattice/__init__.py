"""Spark-native privacy, retrieval and evaluation analytics over clinical text."""

__version__ = "0.1.0"
