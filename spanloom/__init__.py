"""Spark-native analytics for annotated text spans."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
