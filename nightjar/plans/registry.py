"""Registered queries: a Spark job and, where SQL can state it, an equivalent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightjar.plans import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Named parts of the checks, in dependency order; a check lists the ones it needs.
PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (list(needs), sql)


def _expand(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_expand(PARTS[n][0]), n]:
            if m not in out:
                out.append(m)
    return out


def with_parts(sql: str, *names: str) -> str:
    """A complete statement: the named parts as CTEs in front of ``sql`` (which may itself start with CTEs)."""
    ctes = [f"{n} AS MATERIALIZED (\n{PARTS[n][1]}\n)" for n in _expand(list(names))]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[len("WITH RECURSIVE"):].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join([*ctes, body[len("WITH"):].strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def register(name: str, query: Query, sql: str | None = None, *needs: str) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        CHECKS[name] = with_parts(sql, *needs)


part("ev", adapter.events_sql())
part("dt", adapter.detections_sql(), "ev")
