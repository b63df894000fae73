"""Structured Streaming forms of the cleaning, scoring and metric operators."""
