"""Spark-native retrieval, evaluation analytics and corpus processing."""
