"""Evidentia: plans."""
