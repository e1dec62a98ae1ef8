"""Behavioural event analytics on Spark: declarative DataFrame operators designed for very large logs."""

__version__ = "0.1.0"
