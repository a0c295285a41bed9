"""Session-memory analytics on Spark."""
