"""tracefold.sources."""
