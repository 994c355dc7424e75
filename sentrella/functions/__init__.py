"""Functions of the session-security engine."""
