"""Spark-native preparation and evaluation of speech and transcript corpora."""
