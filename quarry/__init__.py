"""Spark-native retrieval, ranking and corpus analytics."""
