"""Structured Streaming forms of the service metrics."""
