"""All registered queries: name -> (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "V9_search_hybrid_rrf"


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"kgweave.{name}")


MODULES = ("operators.graph_tables", "operators.merge", "operators.enrich", "operators.chunks", "operators.models", "operators.graph", "operators.search", "operators.vector_index", "operators.resolve", "operators.evaluation", "sources.corpora", "sources.benchmarks", "sources.derived", "sources.derived_samples", "streaming.ingest", "functions.queries")
