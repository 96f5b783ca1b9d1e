"""Registry of queries: each has a Spark callable and, where plain SQL can say the same, a SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pathweave.plans import fixtures
from pathweave.session import COMPILED, prepare


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(data)``; ``data`` gives access to the tables and derived views of one directory."""

    def deco(fn: Callable[[fixtures.Data], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixtures.Data(prepare(spark, COMPILED), sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, fixtures.with_views(sql) if sql else None)
        return fn

    return deco


def q6(expr: str) -> str:
    """SQL text for half-even rounding to six decimals (twin of functions.numeric.r6)."""
    return f"(round_even(cast({expr} as double)*1e6, 0)/1e6 + 0.0)"


def h32(*parts: str) -> str:
    """SQL text for the 32-bit hash number (twin of functions.numeric.hash_u32)."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint)"
