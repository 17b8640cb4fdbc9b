"""tracefold.streaming."""
