"""Spark-native preparation, retrieval and evaluation of instruction data."""
