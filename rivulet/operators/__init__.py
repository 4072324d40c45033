"""operators of the feed archive."""
