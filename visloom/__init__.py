"""Spark-first analytics for interferometric visibilities."""
