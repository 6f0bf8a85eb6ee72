"""Named queries: a Spark plan per key plus, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_query_conf
from ..sources.fixtures import Tables
from .oracle import with_fixtures


@dataclass(frozen=True)
class Query:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str
    body: str | None = None  # the oracle before its fixture CTEs, for queries built on it


REGISTRY: dict[str, Query] = {}


def register(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` (or ``fn(spark, sf_dir)``) under ``key``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_query_conf(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        run.__wrapped__ = fn  # the plan over a Tables object (e.g. a written layout)
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, run, with_fixtures(oracle) if oracle else None, (fn.__doc__ or "").strip(), oracle)
        return fn

    return deco
