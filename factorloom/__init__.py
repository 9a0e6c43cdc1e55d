"""Spark-native engine for factor research and large-scale table processing."""

__version__ = "0.1.0"
