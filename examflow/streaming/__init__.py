"""Structured Streaming over the response log."""
