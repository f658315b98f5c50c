"""Relational operators over trip and result tables."""
