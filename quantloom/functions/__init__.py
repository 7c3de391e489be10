"""Factor expressions, operators and formula libraries."""
