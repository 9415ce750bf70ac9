"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from laborlake.plans.oracle import with_fx
from laborlake.sources.fixtures import Fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    fn: QueryFn
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Fixtures(spark, sf_dir)),
                               with_fx(sql) if sql else None)
        return fn
    return deco
