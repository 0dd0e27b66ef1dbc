"""Harmonisation, verification, telemetry and result operators: DataFrame in, DataFrame out."""
