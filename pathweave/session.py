"""Session settings and the one shared folder that jobs may write intermediate tables to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Applied only where the cluster has not chosen a value itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE may split a skewed join even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Frames fan out after a shuffle (points, pixels), so small shuffle blocks must not end in one task. With
    # parallelism first this only sets the floor; large shuffles keep the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.sql.session.timeZone": "UTC",
}
# HotSpot only interprets methods of more than 8000 bytes. With this limit a stage whose generated method is longer runs operator by
# operator, in methods that are compiled.
COMPILED = 8000


def get_session(app: str = "pathweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession, method_limit: int = 65535) -> SparkSession:
    """Make a session given by somebody else fit for the library (settings only, no data is read)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
        spark.conf.set(key, DEFAULTS[key])
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", method_limit)
    if named_root(spark) is None:
        spark.conf.set(CHECKPOINT_KEY, fallback_root(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir", "")))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return spark


def named_root(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as named by the cluster; None when nobody named one."""
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)


def fallback_root(master: str, warehouse: str) -> str:
    """Where intermediates go when no folder is named. One machine shares its temporary folder with itself; a cluster must
    offer a warehouse that is no local folder, else part files would stay on the executors that wrote them."""
    if master == "local" or master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="pathweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    if "://" in warehouse and not warehouse.startswith("file:"):
        return f"{warehouse.rstrip('/')}/_pathweave"
    raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share; the warehouse {warehouse!r} is local")


def shared_root(spark: SparkSession) -> str:
    if named_root(spark) is None:
        prepare(spark)
    return named_root(spark)


_MADE: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder. Nothing is created and nothing is cleared here."""
    _MADE.append(f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once the results that read them have been read."""
    dropped = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that lost executors do not cost the history."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
