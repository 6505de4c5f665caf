"""Sensor, event-log and daily-record analytics as Spark DataFrame operators."""
