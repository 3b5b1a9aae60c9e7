"""All queries of the library by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lyceum.plans import activity, candidates, concepts, exam, knowledge, records, relational, streams, study, text

PACKS = (relational, activity, study, text, exam, streams, records, knowledge, concepts, candidates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for pack in PACKS for name, (run, _) in pack.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can't express have no counterpart; tests compare them with plain versions."""
    return {name: sql for pack in PACKS for name, (_, sql) in pack.QUERIES.items() if sql}
