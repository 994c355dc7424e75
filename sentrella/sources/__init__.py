"""Sources of the session-security engine."""
