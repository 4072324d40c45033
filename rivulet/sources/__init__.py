"""sources of the feed archive."""
