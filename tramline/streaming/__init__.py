"""Tramline streaming."""
