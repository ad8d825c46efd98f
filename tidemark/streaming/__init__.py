"""Structured Streaming forms of the bar builder."""
