"""Structured Streaming over growing point tables."""
