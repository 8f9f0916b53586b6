"""Readers for edge lists and item streams."""
