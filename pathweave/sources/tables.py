"""Scans of track tables and writes of derived variants and reports.

Variants (raw, filtered, metric, active ...) are partitions of one dataset directory: adding one writes its own
partition, replacing one swaps that partition only, and reading one prunes to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.sequence import dense_index

VARIANT = "variant"


def scan(spark: SparkSession, paths: Sequence[str], glob: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All parquet files below the given roots or files whose name matches the glob, each file once even when it is
    reachable by two paths. Fails when nothing matches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen: dict[str, None] = {}
    for p in paths:
        path = hadoop.Path(p)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            seen.setdefault(status.getPath().toUri().getPath().rstrip("/"))
    # a root inside another root would be listed twice; keep the outer one
    roots = [r for r in seen if not any(r != o and r.startswith(o + "/") for o in seen)]
    if not roots:
        raise FileNotFoundError(f"no table files under {list(paths)}")
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(*roots)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    return df.select("file", *columns) if columns else df


def write_variant(df: DataFrame, path: str, variant: str, mode: str = "error", dry_run: bool = False,
                  partition_by: Sequence[str] = ()) -> bool:
    """Write one variant of a dataset. mode: skip, error or replace when it exists. Returns whether data was written."""
    if mode not in ("skip", "error", "replace"):
        raise ValueError(mode)
    there = variant in variants(df.sparkSession, path)
    if there and mode == "error":
        raise ValueError(f"variant {variant} exists in {path}")
    if dry_run or (there and mode == "skip"):
        return False
    out = df.drop(VARIANT).withColumn(VARIANT, F.lit(variant))
    (out.write.partitionBy(VARIANT, *partition_by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))
    return True


def variants(spark: SparkSession, path: str) -> list[str]:
    """Variants present in a dataset directory, from the directory listing alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{path}/{VARIANT}=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(s.getPath().getName().split("=", 1)[1] for s in found)


def read_variant(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col(VARIANT) == variant) if variant else df


def backup_variant(tracks: DataFrame, source: str, backup: str, keys: Sequence[str] = ("demo_id",), skip_if: Column | None = None) -> DataFrame:
    """Rows of a backup copy for the demos that have none yet; demos matching ``skip_if`` need no backup."""
    have = tracks.filter(F.col(VARIANT) == backup).select(*keys).distinct()
    rows = tracks.filter(F.col(VARIANT) == source)
    if skip_if is not None:
        rows = rows.filter(~skip_if)
    return rows.join(have, list(keys), "left_anti").withColumn(VARIANT, F.lit(backup))


def activate_variant(tracks: DataFrame, source: str, target: str = "active") -> DataFrame:
    """The tracks with ``source`` copied over ``target`` for the demos that have it."""
    chosen = tracks.filter(F.col(VARIANT) == source)
    have = chosen.select("demo_id").distinct().withColumn("__has", F.lit(True))
    kept = tracks.join(have, "demo_id", "left").filter((F.col(VARIANT) != target) | F.col("__has").isNull()).drop("__has")
    return kept.unionByName(chosen.withColumn(VARIANT, F.lit(target)))


def attributes(df: DataFrame, key: str, **values: Column) -> DataFrame:
    """Provenance rows (key, name, value) in text form, one per named value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in values.items()])
    return df.select(key, F.inline(pairs))


def write_report(df: DataFrame, path: str, fields: Sequence[str], fmt: str = "csv") -> None:
    """Small summary with a fixed column order as one file. Reports are one row per demo, file or task; anything
    larger belongs into a table."""
    w = df.select(*fields).coalesce(1).write.mode("errorifexists")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def only_new(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(outputs.select(*keys).distinct(), list(keys), "left_anti")


def numbered(df: DataFrame, ident: str, out: str) -> DataFrame:
    """Position of each row within its file by the whole number ``ident``, from zero; a file of any size is spread."""
    return dense_index(df, ["file"], [ident], [F.shiftright(ident, 24), F.shiftright(ident, 12)], out)


def match_raw(demos: DataFrame, raws: DataFrame) -> DataFrame:
    """Raw trajectory of every demo of the same file: (file, demo, raw_id).

    ``demos`` is (file, demo, name), ``raws`` is (file, raw_id). The only raw trajectory of a file serves all its demos; of
    several, the number after the last underscore of the name chooses by position, or else the demo's own position.
    Demos whose number is out of range, and demos of files without raw trajectories, have no row.
    """
    of = numbered(raws.select("file", "raw_id"), "raw_id", "at")
    tail = F.substring_index("name", "_", -1)
    d = numbered(demos.select("file", "demo", "name"), "demo", "own").join(of.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file")
    number = F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint")).otherwise(F.col("own").cast("bigint"))
    d = d.withColumn("at", F.when(F.col("n") == 1, F.lit(0)).otherwise(number))
    return d.join(of, ["file", "at"]).select("file", "demo", "raw_id")


def nested_lines(rows: DataFrame, entry: str = "entry") -> DataFrame:
    """Lines (task, demo_id, s0, line) that make one nested JSON text per task when read in this order.

    ``rows`` is (task, demo_id, s0, n_frames, entry), one JSON text per segment. The first line of a task and of a demo carries its
    head with the counts, the last one its end; a line holds one segment, so neither a demo nor a task is gathered.
    """
    def counts(*keys):
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_frames").alias("n_frames"), F.min("s0").alias("first"), F.max("s0").alias("last"))

    demos = counts("task", "demo_id")
    tasks = demos.groupBy("task").agg(F.struct(F.count(F.lit(1)).alias("n_demos"), F.sum("n_segments").alias("n_segments"), F.sum("n_frames").alias("n_frames"),
                                               F.min("demo_id").alias("first"), F.max("demo_id").alias("last")).alias("of_task"))
    r = rows.select("task", "demo_id", "s0", F.col(entry).alias("__entry")).join(demos, ["task", "demo_id"]).join(tasks, "task")
    opens, closes = F.col("s0") == F.col("first"), F.col("s0") == F.col("last")
    first_demo, last_demo = F.col("demo_id") == F.col("of_task.first"), F.col("demo_id") == F.col("of_task.last")

    def head(columns, key):  # an object up to the list that it ends with
        return F.concat(F.expr(f"substring(to_json({columns}), 1, length(to_json({columns})) - 1)"), F.lit(f',"{key}":['))

    task_head = head("struct(task, of_task.n_demos, of_task.n_segments, of_task.n_frames)", "demos")
    demo_head = head("struct(demo_id, n_segments, n_frames)", "segments")
    line = F.concat(F.when(opens & first_demo, task_head).otherwise(F.lit("")), F.when(~opens | ~first_demo, F.lit(",")).otherwise(F.lit("")),
                    F.when(opens, demo_head).otherwise(F.lit("")), F.col("__entry"),
                    F.when(closes, F.lit("]}")).otherwise(F.lit("")), F.when(closes & last_demo, F.lit("]}")).otherwise(F.lit("")))
    return r.select("task", "demo_id", "s0", line.alias("line"))


def write_nested(rows: DataFrame, path: str) -> None:
    """``nested_lines`` as text files whose lines, in the order of the file names, are the JSON texts one after the other."""
    order = ["task", "demo_id", "s0"]
    lines = nested_lines(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("errorifexists").text(path)
