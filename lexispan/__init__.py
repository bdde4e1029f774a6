"""Spark-native extraction and analytics of technical-term mentions in text corpora."""
