"""Whole experiments, by name."""
