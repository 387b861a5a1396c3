"""Evidentia: sources."""
