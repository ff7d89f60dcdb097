"""Whole questions over the graph and the steps that build it."""
