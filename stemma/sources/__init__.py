"""Readers and table views."""
