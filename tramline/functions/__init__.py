"""Tramline functions."""
