"""Log, telemetry and corpus analytics on Spark."""
