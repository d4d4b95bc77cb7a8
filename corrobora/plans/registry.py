"""A small registry: one entry per operator query, with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrobora.plans.testbed import Testbed, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(testbed) -> DataFrame``; ``oracle`` is SQL text over the testbed tables."""

    def register(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return register
