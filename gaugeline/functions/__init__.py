"""Labels and column functions."""
