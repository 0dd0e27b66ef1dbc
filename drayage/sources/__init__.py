"""Readers: whole tables, key-range splits, monthly files, message streams, catalogs, generators."""
