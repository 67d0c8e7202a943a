"""Sensor-event analytics on Spark."""
