"""Scan-event anomaly analytics as PySpark DataFrame operators."""
