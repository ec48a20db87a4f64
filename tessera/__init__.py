"""Tessera: a Spark-native tokenization and text-analytics engine."""

__version__ = "0.1.0"
