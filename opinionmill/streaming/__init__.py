"""Continuous forms of the batch plans."""
