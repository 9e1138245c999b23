"""Named queries over the given tables."""
