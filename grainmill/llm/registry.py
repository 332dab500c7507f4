"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("readability", "percentiles", "ranking", "cutoff", "prose", "sampling", "encoding", "mixing", "residue")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"grainmill.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"grainmill.llm.{m}").ORACLE.items()}
