"""Streams of step events."""
