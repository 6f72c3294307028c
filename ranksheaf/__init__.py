"""Ranked-retrieval and evaluation analytics as PySpark DataFrame jobs."""
