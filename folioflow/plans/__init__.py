"""Named queries over the table set and their SQL."""
