"""Structured Streaming versions of the log aggregates."""
