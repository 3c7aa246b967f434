"""Airplay monitoring and royalty accounting as Spark DataFrame operators."""

__version__ = "0.1.0"
