"""Structured Streaming forms of the first pipeline steps."""
