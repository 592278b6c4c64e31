"""Structured Streaming versions of the operators that are natural streams."""
