"""All registered queries of the library's own operators."""

from __future__ import annotations

from sensorline.plans import arrival_queries, sample_queries

_ALL = {**arrival_queries.QUERIES, **sample_queries.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
