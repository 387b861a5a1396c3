"""Evidentia: streaming."""
