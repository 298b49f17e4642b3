"""Spark jobs for single-cell image measurement at population scale."""
