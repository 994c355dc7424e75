"""Streaming of the session-security engine."""
