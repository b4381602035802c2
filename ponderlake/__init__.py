"""Spark-first analytics for reasoning-model post-training data."""
