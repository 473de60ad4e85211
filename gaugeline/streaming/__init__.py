"""Stream drivers."""
