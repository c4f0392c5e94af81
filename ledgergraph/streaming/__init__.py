"""Structured Streaming operators for processing status and quality metrics."""
