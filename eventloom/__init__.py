"""Temporal event analytics as Spark DataFrame functions."""
