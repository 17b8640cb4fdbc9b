"""tracefold.operators."""
