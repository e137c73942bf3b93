"""Streaming ingestion and change-data-capture engine on PySpark."""

__version__ = "0.1.0"
