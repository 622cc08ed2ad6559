"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _parts():
    from riskloom.plans import domain, more, relational

    return relational, domain, more


def queries() -> dict[str, Query]:
    return {k: q for part in _parts() for k, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for part in _parts() for k, t in part.oracle_sql().items()}
