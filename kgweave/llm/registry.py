"""The subpackage's queries and SQL, gathered from its modules."""

from __future__ import annotations

import importlib

MODULES = ("mixing", "simhash", "neighbours", "tokens", "topk", "materialise", "langid", "packing", "substrings", "sharding", "secret_scan", "spelling", "manifest")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"kgweave.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
