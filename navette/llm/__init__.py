"""Operators for preparing training text: scoring, formatting, deduplication, filtering, mixing."""
