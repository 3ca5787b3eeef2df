"""Spark-native analytics over parsed documents: chunking, retrieval, answer scoring and trials."""

__version__ = "0.1.0"
