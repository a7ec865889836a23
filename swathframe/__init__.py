"""Spark-first analytics for satellite-radar datasets."""
