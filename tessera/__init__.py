"""Spark-first analytics for evaluation data and training-data hygiene."""
