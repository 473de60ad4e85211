"""Industrial telemetry as Spark jobs."""
