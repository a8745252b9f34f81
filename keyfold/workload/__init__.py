"""Every operator as a query over the given tables, with the SQL that must agree."""

from __future__ import annotations

from keyfold.workload import feeds, reads, registry, streams, validation, writes

GROUPS = (reads, writes, validation, registry, feeds, streams)


def queries() -> dict:
    return {name: run for group in GROUPS for name, run in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
