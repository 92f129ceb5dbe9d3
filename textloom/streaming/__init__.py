"""Annotation of streams."""
