"""The queries of the corpus operators and the SQL that they are held against."""

from __future__ import annotations

import importlib

MODULES = ("sharding", "decontaminate", "substring", "language", "toxicity", "bpe", "secrets", "quality", "simhash", "neighbours", "alignment", "negatives", "topk")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"tallyloom.llm.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
