"""Streams into collections."""
