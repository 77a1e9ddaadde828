"""Structured Streaming forms of the memory and index operators."""
