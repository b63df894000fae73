"""Severity analytics on Spark: label, clean, split, featurize, score and rank text."""
