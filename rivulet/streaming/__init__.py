"""streaming of the feed archive."""
