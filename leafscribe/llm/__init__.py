"""Preparing page texts as training data."""
