"""Lodestone: a PySpark-native engine for document ingestion, hybrid retrieval and answer checks."""

__version__ = "0.1.0"
