"""Vehicle-telemetry analytics as plain functions from DataFrame to DataFrame."""
