"""Flight-telemetry and aerial-survey analytics as Spark DataFrame operators."""
