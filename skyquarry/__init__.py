"""skyquarry: telemetry analytics as PySpark plans."""
