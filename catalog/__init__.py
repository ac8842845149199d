"""Queries over the given tables, each with independent SQL where SQL can state it."""

from importlib import import_module

SECTIONS = ("scalars", "tables", "features", "files", "learning", "clustering")


def load():
    """Import every section and return the registry."""
    for section in SECTIONS:
        import_module(f"catalog.{section}")
    return import_module("catalog.base")
