"""Document question answering and its quality telemetry as Spark jobs."""
