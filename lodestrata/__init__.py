"""Lodestrata: a Spark-first engine that indexes code and documents and answers retrieval queries."""

__version__ = "0.1.0"
