"""Spark-native graph analytics on edge tables."""

__version__ = "0.1.0"
