"""Spark-native analytics for iterated-transformation experiments."""
