"""Spark-native text index, hybrid search and anomaly analytics."""
