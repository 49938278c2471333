"""Structured Streaming front of the engine."""
