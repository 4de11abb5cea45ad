"""Spark-native store, search and analysis of typed text records."""
