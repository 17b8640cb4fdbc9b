"""tracefold.functions."""
