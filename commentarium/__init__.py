"""Commentarium: free-text feedback analytics as Spark DataFrame work."""

__version__ = "0.1.0"
