"""The queries of this subpackage and their SQL twins, one module for each operator."""

from __future__ import annotations

import importlib

MODULES = ("line_dedup", "bpe", "nn_descent", "chat", "quality", "simhash", "toxicity", "secrets", "packing", "url_filter")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"keystrata.llm.{name}"), what)()
    return out


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict:
    return _all("oracle_sql")
