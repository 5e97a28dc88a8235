"""Operators for preparing training text: deduplication, decontamination, quality, mixing."""
