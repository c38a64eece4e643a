"""Leakage-safe event-risk analytics as Spark DataFrame operators."""
