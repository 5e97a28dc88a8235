"""Declarative queries and what they need from a session."""
