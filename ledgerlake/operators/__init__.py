"""Operators over logs, versions, projections and governed tables."""
