"""Intermediate tables of the llm operators, and joins that several of them need."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.session import materialize, prepare

#: Rows and bytes that a task works on at once.
ROWS, BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator works on, so that further columns and their names don't matter."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A table in the shared folder instead of the lineage."""
    return materialize(df, f"llm-{purpose}")


def small_batches(spark: SparkSession) -> None:
    """Python workers get few rows and bytes at a time, as a row may be a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_results(df: DataFrame, column: str, fields: T.StructType, start, needs: Sequence[str] = ("text",)) -> DataFrame:
    """Add struct ``column``, computed in Arrow batches from the whole of ``needs``; no other column leaves the JVM.

    ``start`` is called once per task and returns the function from those columns to a list of arrays, one per field.
    A column that already bears the name of the new one (in any case) is replaced. No shuffle.
    """
    names = fields.names

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        compute = start()
        for arrays in batches:
            yield pa.StructArray.from_arrays(compute(*arrays), names)
        give_back()

    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((a,) for a in batches)

    small_batches(df.sparkSession)
    # said to be nondeterministic, so that a filter on the result doesn't compute it a second time
    made = F.arrow_udf(run_one if len(needs) == 1 else run, fields).asNondeterministic()
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != column.lower()]
    return df.select(*kept, made(*[F.col(f"`{c}`") for c in needs]).alias(column))
