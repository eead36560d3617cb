"""Spark-native capability and risk analytics for corpora of agent skill packages."""

__version__ = "0.1.0"
