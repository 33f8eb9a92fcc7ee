"""Structured Streaming forms of the keyed and windowed operators."""
