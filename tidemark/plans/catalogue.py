"""The queries registered for the engine's own operators, each with DuckDB SQL for the same result."""

from __future__ import annotations

from . import batch, briefs, concepts, context, evidence, extract, judging, phrases, probes, ranking, readers, records, search, store, text, upkeep

_PARTS = search, ranking, records, evidence, text, extract, batch, judging, context, upkeep, briefs, phrases, readers, concepts, probes, store


def queries() -> dict:
    return {name: f for part in _PARTS for name, (f, _) in part.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.REGISTERED.items() if sql}
