"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("quality", "experiments", "schemes", "corpora", "bridge", "mixtures", "losses", "streams", "refits", "more")
FLAGSHIP = "domain_summary"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"grainmill.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"grainmill.plans.{m}").ORACLE.items()}
