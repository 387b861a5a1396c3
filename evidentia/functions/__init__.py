"""Evidentia: functions."""
