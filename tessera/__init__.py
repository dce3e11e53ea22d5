"""Spark-native document-to-graph analytics: sources, operators, plans and streaming."""

__version__ = "0.1.0"
