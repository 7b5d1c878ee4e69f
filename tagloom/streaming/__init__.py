"""Structured Streaming versions of preparation, refinement and publishing."""
