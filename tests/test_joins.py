"""Joins whose sides fan out after Spark has estimated them."""

import pytest
from pyspark.sql import functions as F

from pathweave.operators import calibration as cal
from pathweave.operators import lifting
from pathweave.plans.fixtures import Data
from pathweave.session import prepare

KEY = ["demo_id", "t", "point_id"]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n):
    frames = spark.range(n).select((F.col("id") % 3).alias("demo_id"), F.floor(F.col("id") / 3).cast("int").alias("t"))
    return frames.select("demo_id", "t", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("point_id")).withColumns(
        {c: F.col("t") * 7 + F.col("point_id") for c in ("xu", "yu", "zu")})


def test_exploded_sides_are_never_broadcast(spark):
    p = points(spark, 30)
    c = cal.pair(p, p.withColumn("xu", F.col("xu") + 1), KEY, ("xu", "yu", "zu"), ("xu", "yu", "zu"), carry=["zu"])
    assert "SortMergeJoin" in planned(c) and "Broadcast" not in planned(c)
    rows = c.collect()
    assert len(rows) == 30 * 24 and all(r.dx == r.sx + 1 and r.sz == r.zu and isinstance(r.sx, float) for r in rows)


def test_images_made_by_expressions_are_never_broadcast(spark):
    images = spark.range(30).select((F.col("id") % 3).alias("demo_id"), F.floor(F.col("id") / 3).cast("int").alias("t"),
                                    F.array_repeat(F.col("id"), 256).alias("z"))
    j = lifting.on_frame(points(spark, 30), images)
    assert "SortMergeJoin" in planned(j) and "Broadcast" not in planned(j)
    assert j.count() == 30 * 24


@pytest.mark.parametrize("what", ["tracks", "uv"])
def test_frames_meet_before_their_points_are_written_out(spark, what):
    d = Data(prepare(spark), "/root/testdata/sf0.001")
    cam = d.camera().filter("t % 3 = 0").select("demo_id", "t", "tx")
    got = getattr(d, what)(cam)
    want = lifting.on_frame(getattr(d, what)(), cam).select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
