"""Spark-native retrieval, event analytics and corpus maintenance."""
