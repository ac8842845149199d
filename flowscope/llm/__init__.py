"""Operators for preparing training text: rating, counting, linking, matching, deduplication, mixing and sharding."""
