"""Registered queries: each runs one operator over whole tables, most with SQL of the same result."""
from __future__ import annotations

from importlib import import_module

GROUPS = ("graph", "text", "similarity", "verification", "runlogs", "instructions", "learning", "corpus", "stores", "streams")


def registry() -> dict:
    """name -> (callable(spark, folder), SQL or None)."""
    out = {}
    for group in GROUPS:
        out.update(import_module(f"{__name__}.{group}").QUERIES)
    return out
