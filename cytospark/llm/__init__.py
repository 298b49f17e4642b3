"""Operators for training-data pipelines: one module an operator, queries in ``queries``."""
