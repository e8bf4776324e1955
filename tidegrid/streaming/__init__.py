"""Structured Streaming form of the daily run."""
