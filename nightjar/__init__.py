"""Security telemetry analytics as DataFrame transformations and Structured Streaming jobs."""
