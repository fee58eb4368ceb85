"""Arriving files."""
