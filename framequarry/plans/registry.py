"""Where each plans module registers its queries: a name, a function of (spark, sf_dir), and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequarry.schema import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """Registers a query over the adapted frames."""
    add_tables(name, lambda spark, sf_dir: plan(frames(spark, sf_dir)), oracle)


def add_tables(name: str, plan: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Registers a query over the tables of a folder."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = plan
    if oracle is not None:
        ORACLE_SQL[name] = oracle
