"""Relational analytics over collections of paged documents, planned by Spark."""

__version__ = "0.1.0"
