"""Operators for preparing training text: counting, deduplication, scanning, packing, scoring."""
