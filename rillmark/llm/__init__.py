"""Operators for preparing training text: scoring, scanning, deduplication, mixing and encoding."""
