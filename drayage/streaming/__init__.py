"""Snapshots and usage as streams."""
