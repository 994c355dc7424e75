"""Operators of the session-security engine."""
