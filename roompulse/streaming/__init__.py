"""Streaming forms of the metrics."""
