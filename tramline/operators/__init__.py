"""Tramline operators."""
