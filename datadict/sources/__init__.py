"""Readers of catalog dumps and lake tables, and the dictionary writers."""
