"""Comparison of tables with PySpark."""

__version__ = "0.1.0"
