"""Stored tables, landing feeds and sinks."""
