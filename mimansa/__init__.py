"""Spark-native retrieval, catalog matching and evidence analytics."""
