"""Siltstone: a PySpark-native document-intelligence engine."""

__version__ = "0.1.0"
