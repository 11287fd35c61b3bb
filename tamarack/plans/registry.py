"""All registered queries of the library's core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.plans import aggregates, bills, changes, dialects, hierarchies, joins, nested, ordering, problems, procedural, scalars, source_code, stored, streams

_MODULES = [scalars.P, joins.P, aggregates.P, ordering.P, hierarchies.P, bills.P, changes.P, nested.P, streams.P, stored.P, source_code.P, dialects.P, procedural.P]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | {name: f for m in _MODULES for name, f in m.queries.items()}


def oracles() -> dict[str, str]:
    return problems.ORACLES | {name: sql for m in _MODULES for name, sql in m.oracles.items()}
