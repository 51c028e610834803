"""Anonymisation of streams."""
