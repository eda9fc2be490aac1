"""Streams into kept tables."""
