"""Spark-native evaluation analytics: ingest, slice, sample, score, compare and gate."""
