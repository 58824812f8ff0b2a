"""Scans, sinks and table bindings."""
