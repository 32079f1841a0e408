"""Structured Streaming versions of the job operators."""
