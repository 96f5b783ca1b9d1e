from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from pathweave.operators import segments as seg
from pathweave.session import scratch_dir
from pathweave.streaming import processors as proc
from pathweave.streaming.sources import run_to_table


def stream_of(spark, df, parts):
    """The rows as one file per filter of ``parts``; arrival order is file order."""
    folder = scratch_dir(spark, "stream")
    for cond in parts:
        df.filter(cond).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def steps(spark):
    start = pd.Timestamp("2024-01-01")
    rows = [(d, start + pd.Timedelta(minutes=7 * t + d), d * 1000 + t, (t // (3 + d)) % 2, float(t % 5 * 10)) for d in range(4) for t in range(40)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["demo_id", "ts", "event_id", "state", "value"]))


def test_history_in_several_batches(spark):
    df = steps(spark)
    cut = F.col("event_id") % 1000
    out = run_to_table(proc.history(stream_of(spark, df, [cut < 15, (cut >= 15) & (cut < 16), cut >= 16]), 3), "history")
    got = {r["event_id"]: r["history"] for r in out.collect()}
    assert got[0] == "0,0,0" and got[16] == "14,15,16" and got[3039] == "3037,3038,3039" and len(got) == 160


def test_segments_match_batch_and_pending_change_is_flushed(spark):
    df = steps(spark).withColumn("state", F.when(F.col("event_id") % 1000 >= 38, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    # a late key far in the future moves the watermark, so idle keys time out
    far = spark.createDataFrame([(99, datetime(2025, 1, 1), 99000, 0, 0.0), (99, datetime(2025, 6, 1), 99001, 0, 0.0)], df.schema)
    both = df.unionByName(far)
    s = stream_of(spark, both, [F.col("demo_id") < 99, F.col("event_id") == 99000, F.col("event_id") == 99001])
    out = run_to_table(proc.segments(s.withWatermark("ts", "1 hour"), 3, idle="1 day"), "segments")
    got = sorted((r["demo_id"], r["t"]) for r in out.filter("demo_id < 99").collect())
    batch = df.withColumn("t", (F.col("event_id") % 1000).cast("int"))
    want = sorted((r["demo_id"], r["t"]) for r in seg.debounced_changes(batch, "state", 3).collect())
    assert got == want and (0, 38) in got


def test_jumps_and_episode(spark):
    df = steps(spark)
    cut = F.col("event_id") % 1000
    out = run_to_table(proc.jumps(stream_of(spark, df, [cut < 7, cut >= 7]), 25.0), "jumps").toPandas()
    assert (out.groupby("demo_id").size() == 7).all() and out["exceed"].max() == 7
    s = stream_of(spark, df.withColumn("success", F.col("event_id") % 1000 == 12), [cut < 7, cut >= 7])
    ep = run_to_table(proc.episode(s), "episode").groupBy("demo_id").agg(F.max("length").alias("n")).collect()
    assert {r["n"] for r in ep} == {13}


def test_late_rows_inside_the_watermark_count(spark):
    df = steps(spark)
    late = F.col("event_id") % 1000 == 10
    s = stream_of(spark, df, [~late & (F.col("event_id") % 1000 < 12), late, F.col("event_id") % 1000 >= 12])
    g = s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = run_to_table(g.select("n"), "late", mode="complete")
    assert out.agg(F.sum("n")).first()[0] == df.count()


def test_windows_close_and_rows_past_the_watermark_are_dropped(spark):
    df = steps(spark)  # 40 steps of 7 minutes from midnight on, for each demo
    step = F.col("event_id") % 1000
    s = stream_of(spark, df, [(step >= 2) & (step < 20), step >= 20, step < 2])
    g = s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    got = {r["hour"]: r["n"] for r in run_to_table(g.select(F.hour("w.start").alias("hour"), "n"), "closing").collect()}
    rows = df.withColumn("hour", F.hour("ts")).filter(step >= 2).groupBy("hour").count().collect()
    want = {r["hour"]: r["count"] for r in rows}
    assert got == {h: n for h, n in want.items() if h < 4}  # the last hour is still open
