"""Keyed state over ordered or streamed rows."""
