"""Spark-native conversational-memory analytics."""

__version__ = "0.1.0"
