"""Points are written out after the frames have come together, so that no shuffle moves them."""

import re

import pytest
from pyspark.sql import functions as F

from pathweave.operators import filters as flt
from pathweave.operators.motion import steps_between
from pathweave.operators.sampling import upsample_linear
from pathweave.plans import load_all
from pathweave.plans.fixtures import Data


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a03_delta_norm_stats", "a37_visibility_filter", "j23_interp_linear"])
def test_windows_read_points_where_they_are_written_out(spark, sf_dir, name):
    text = plan(load_all()[name].run(spark, sf_dir))
    between = re.search(r"- Window (.*?)- Generate", text, re.S).group(1)
    assert "Exchange" not in between


def test_mode_meets_the_frames_of_its_demo(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(load_all()["h08_uv_mode"].run(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in text[: text.index("Generate")]


def test_clean_export_joins_no_points(spark, sf_dir):
    assert "Join" not in plan(load_all()["s16_clean_export"].run(spark, sf_dir)).split("Generate")[0]


def test_halo_of_frames_equals_halo_of_points(spark, sf_dir):
    d = Data(spark, sf_dir)
    cols = ["demo_id", "t", "point_id", "step"]
    a, b = steps_between(d.tracks(halo=(1, 0))).select(*cols), steps_between(d.tracks()).select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_upsample_leaves_out_frames_beside_a_gap(spark):
    src = spark.createDataFrame([(1, 0, ts, float(v)) for ts, v in ((0, 0), (1, 30), (3, 90), (4, 60))], "demo_id int, point_id int, ts int, x double")
    n = spark.createDataFrame([(1, 15)], "demo_id int, t_len int")
    got = {r.t: r.x for r in upsample_linear(src, n, 3, ["demo_id", "point_id"], ["x"]).collect()}
    assert got.keys() == {0, 1, 2, 9, 10, 11, 12, 13, 14}
    assert [round(got[t], 9) for t in (0, 1, 2, 9, 10, 11, 12, 13, 14)] == [0, 10, 20, 90, 80, 70, 60, 60, 60]


def test_copied_tracks_are_written_out_after_their_donors_are_known(spark, sf_dir):
    assert "Join" not in plan(load_all()["j10_copy_tracks"].run(spark, sf_dir)).split("Generate")[0]


def test_picked_tracks_equal_copied_tracks(spark, sf_dir):
    d = Data(spark, sf_dir)
    flags = d.tracks().filter("t = 0").withColumn("inlier", (F.col("point_id") + F.col("demo_id")) % 3 > 0).filter("demo_id % 4 > 0 or point_id > 30")
    flags = flags.unionByName(d.tracks().filter("t = 0 and demo_id % 4 = 0").withColumn("inlier", F.lit(False)))  # demos without donors
    donors = flt.nearest_donor(flags, "inlier")
    a = flt.copy_tracks(d.tracks(), donors)
    b = d.tracks(flt.copies(flags, donors)).select("demo_id", "t", F.col("to").alias("point_id"), "xu", "yu", "zu")
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
