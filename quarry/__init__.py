"""Similarity-based transaction scoring, and operators for training-data pipelines, on Spark."""
