"""Evidentia: operators."""
