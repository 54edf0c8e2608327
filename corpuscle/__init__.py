"""Spark-native search and analytics over corpora of source files and documents."""

__version__ = "0.1.0"
