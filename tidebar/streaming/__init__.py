"""Structured Streaming: the paper portfolio."""
