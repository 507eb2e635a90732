"""Operators on event streams."""
