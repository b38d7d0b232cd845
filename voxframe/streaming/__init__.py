"""Structured Streaming forms of the sequence and resume operators."""
