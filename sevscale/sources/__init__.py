"""Readers, writers, staged tables and the frames derived from the given tables."""
