"""Plans of the session-security engine."""
