"""Structured Streaming and job state."""
