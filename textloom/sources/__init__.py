"""Readers and writers of the formats."""
