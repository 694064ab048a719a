"""Spark-native analytics over document corpora: citation graphs, outlier scores, screening."""

__all__ = ["session"]
