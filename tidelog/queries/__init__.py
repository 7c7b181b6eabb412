"""All queries of the core, by name."""

from __future__ import annotations

import importlib

MODULES = ("core", "shell", "log", "schema", "stream", "binlog")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tidelog.queries.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict:
    return _all("SQL")
