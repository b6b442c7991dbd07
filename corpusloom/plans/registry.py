"""All registered queries of the core and their SQL."""

from __future__ import annotations

from corpusloom.plans import catalog, corpus, evaluation, folders, inspection, integrity, maintenance, outline, search, upkeep

MODULES = (search, corpus, catalog, evaluation, inspection, outline, folders, maintenance, upkeep, integrity)
FLAGSHIP = "hybrid_search"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
