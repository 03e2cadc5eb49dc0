"""Access logs as streams."""
