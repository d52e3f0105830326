"""Spark-native profiling and de-identification of tables and free text."""

__version__ = "0.1.0"
