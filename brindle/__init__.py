"""Spark-native analytics over source-code corpora, query evidence and training text."""
