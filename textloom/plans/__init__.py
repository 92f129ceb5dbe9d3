"""Pipelines of operators and the named queries."""
