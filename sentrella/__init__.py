"""Session-security analytics on Spark."""
