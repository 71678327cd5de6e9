"""Spark-native record intake and decisioning engine."""
