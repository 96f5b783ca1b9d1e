"""What a set of Parquet tables holds, from footers alone."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.session import materialize

#: With these settings Spark's Parquet scan answers counts and bounds from the footers, file by file, in tasks.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


@contextmanager
def footers(spark: SparkSession) -> Iterator[None]:
    """Tables that are read and used in here answer counts and bounds from their footers."""
    before = {k: spark.conf.get(k, None) for k in FOOTERS}
    try:
        for k, v in FOOTERS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def column_counts(name: str, df: DataFrame) -> DataFrame:
    """One row per column: rows of the table, values of a flat column."""
    def known(c: str):  # footers of no row group at all leave a count open that the plan takes for set, so a coalesce would not see it
        return F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0)).cast("bigint")

    flat = [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(flat)])
    columns = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"), known("rows").alias("n_rows"),
                        (known(f"n{flat.index(f.name)}") if f.name in flat else F.lit(None).cast("bigint")).alias("n_values"),
                        F.lit(json.dumps(f.metadata, sort_keys=True) if f.metadata else None).cast("string").alias("attributes")) for i, f in enumerate(df.schema)]
    return counts.select(F.lit(name).alias("tbl"), F.inline(F.array(*columns)))


def column_bounds(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per given column of whole numbers: its least and largest value."""
    at = dict(enumerate(columns))
    found = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in at.items() for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").cast("bigint").alias("lo"), F.col(f"hi{i}").cast("bigint").alias("hi")) for i, c in at.items()]
    return found.select(F.lit(name).alias("tbl"), F.inline(F.array(*pairs)))


def inspect_tables(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One row per column of every table: tbl, column, position, dtype, n_rows, n_values, attributes, lo, hi.

    Counts and bounds come from footers. Only bounds of whole-number columns that hold nulls are read from the column itself, as a row
    group of nulls states none. Nested columns have no n_values (their footers count leaves), only whole numbers have bounds, and a
    column without a value has none. An empty table keeps its columns with counts of zero.
    """
    if not paths:
        raise ValueError("no tables to inspect")
    plain = {n: spark.read.parquet(p) for n, p in paths.items()}
    with footers(spark):
        read = {n: spark.read.parquet(p) for n, p in paths.items()}
        counts = materialize(reduce(DataFrame.unionByName, [column_counts(n, df) for n, df in read.items()]), "catalog")
        gaps = {(r["tbl"], r["column"]) for r in counts.filter("n_values < n_rows").select("tbl", "column").collect()}  # at most one per column
        parts = []
        for n, df in read.items():
            whole = [f.name for f in df.schema if isinstance(f.dataType, WHOLE)]
            for source, columns in ((df, [c for c in whole if (n, c) not in gaps]), (plain[n], [c for c in whole if (n, c) in gaps])):
                if columns:
                    parts.append(column_bounds(n, source, columns))
        none = spark.createDataFrame([], "tbl string, column string, lo bigint, hi bigint")
        bounds = materialize(reduce(DataFrame.unionByName, parts, none), "bounds")
    return counts.join(bounds, ["tbl", "column"], "left")
