"""Whole-table movement, harmonisation, verification and run telemetry on Spark."""
