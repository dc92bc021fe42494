"""Scans, sinks and the adapters that turn tables into panels."""
