"""functions of the feed archive."""
