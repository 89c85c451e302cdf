"""Structured Streaming forms of the bar, text, position and buffer operators."""
