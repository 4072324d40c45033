"""plans of the feed archive."""
