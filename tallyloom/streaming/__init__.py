"""Streams of normalized records."""
