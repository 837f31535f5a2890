"""leadwake: point-in-time lead-lag and event studies as Spark jobs."""
