"""Structured Streaming: applying a log to projections as it grows."""
