"""Structured Streaming extensions of the engine."""
