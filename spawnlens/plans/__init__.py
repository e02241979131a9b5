"""Queries by name, and their SQL."""
