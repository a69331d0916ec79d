"""Scans and sinks with the checks that a contract needs."""
