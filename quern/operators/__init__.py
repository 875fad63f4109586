"""Operators over indexes: building, searching, suggesting, snippets, metrics, maintenance."""
