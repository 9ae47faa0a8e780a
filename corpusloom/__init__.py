"""Spark-native curation of text corpora and evaluation analytics."""
