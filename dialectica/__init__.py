"""dialectica: argument-based recommendation analytics and training-data operators on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
