"""Jobs over deliveries, journal and readings."""
