"""Race timing and telemetry analytics as lazy Spark DataFrame functions."""
