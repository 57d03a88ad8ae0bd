"""Spark-native analytics over large collections of hierarchical text documents."""
