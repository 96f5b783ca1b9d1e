"""Groups that fit a task are worked out at once; longer ones take several passes, with the same results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.functions.numeric import hash_u32, text
from pathweave.operators import calibration as cal
from pathweave.operators import whole as wh
from pathweave.plans import calibration as pc
from pathweave.plans import load_all
from pathweave.plans.fixtures import Data


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 0 and list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype == object:
            assert a[c].isna().tolist() == b[c].isna().tolist()
            both = [(x, y) for x, y in zip(a[c], b[c]) if x is not None]
            if both and isinstance(both[0][0], str):
                assert all(x == y for x, y in both)
            else:
                np.testing.assert_allclose(*[np.array(v, float) for v in zip(*both)], rtol=1e-9, atol=2e-6)
        elif a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=2e-6)
        else:
            assert a[c].tolist() == b[c].tolist()


def both_ways(spark, sf_dir, monkeypatch, name, keys):
    """The query with every demo in one task, and with demos of more than 65 frames in several passes."""
    a = load_all()[name].run(spark, sf_dir)
    by_size = Data.by_size
    sizes = []

    def split(self, limit=65):
        small, large = by_size(self, 65)
        sizes.append((small.frames().count(), large.frames().count()))
        return small, large

    monkeypatch.setattr(Data, "by_size", split)
    same(a, load_all()[name].run(spark, sf_dir), keys)
    assert all(min(s) > 0 for s in sizes) and sizes
    return a


def test_points_of_a_whole_demo_are_not_shuffled(spark, sf_dir):
    small, large = Data(spark, sf_dir).by_size()
    assert large is None
    text_ = plan(pc.robust(pc.correspondences(small, vis=False), ["demo_id"], ["t", "point_id"], 16, 50.0, True))
    assert "Exchange" not in re.search(r"FlatMapGroupsInArrow(.*?)Generate", text_, re.S).group(1)


def test_hashes_of_whole_numbers(spark):
    rows = [(i * 37 - 50, i % 7, i) for i in range(100)]
    want = [r.h for r in spark.createDataFrame(rows, "a bigint, b int, c bigint").coalesce(1).select(hash_u32("a", "b", "c", text("x"), 3).alias("h")).collect()]
    assert wh.hashes([np.array(c) for c in zip(*rows)], "x", 3).tolist() == want


@pytest.mark.parametrize("iterations", [8, 64])
def test_ransac_at_once_equals_ransac_in_passes(spark, sf_dir, iterations):
    """Groups of every kind: more rows than are drawn from, few rows, the same point over and over, noise only."""
    c = pc.correspondences(Data(spark, sf_dir), vis=False).filter("demo_id < 8").withColumn("s0", F.least(F.floor(F.col("t") / 9), F.lit(4)).cast("int"))
    c = c.filter("demo_id <> 1 or s0 > 0 or (t = 0 and point_id < 2)").filter("demo_id <> 2 or point_id < 3")
    c = c.withColumns({x: F.when(F.col("demo_id") == 3, 1.0).otherwise(F.col(x)) for x in cal.SRC})
    c = c.withColumns({x: F.when(F.col("demo_id") == 4, F.col("sx") * (i + 1) % 977).otherwise(F.col(x)) for i, x in enumerate(cal.DST)})
    c = c.localCheckpoint()
    keys, ids = ["demo_id", "s0"], ["t", "point_id"]
    same(wh.ransac_sim3(c, ["demo_id"], keys, ids, iterations, 50.0), cal.ransac_sim3(c, keys, ids, iterations, 50.0), keys)


def test_ransac_query_in_one_task_and_in_passes(spark, sf_dir, monkeypatch):
    both_ways(spark, sf_dir, monkeypatch, "a29_ransac_sim3", ["demo_id"])


@pytest.mark.parametrize("name, keys", [
    ("a31_stage_transform", ["demo_id", "s0"]), ("a28_robust_trim_fit", ["demo_id"]), ("j20_score_hypotheses", ["demo_id", "h"]), ("a30_calibrate", ["demo_id"]),
    ("a07_err_stats", ["demo_id"]), ("a09_reference_error", ["demo_id"])])
def test_demos_in_one_task_equal_demos_in_passes(spark, sf_dir, monkeypatch, name, keys):
    both_ways(spark, sf_dir, monkeypatch, name, keys)


def test_noise_follows_a_track_in_one_task_and_in_blocks(spark, sf_dir, monkeypatch):
    both_ways(spark, sf_dir, monkeypatch, "h27_noise_augmentation", ["demo_id", "t", "point_id"])


@pytest.mark.parametrize("name", ["a35_quality_mask", "h27_noise_augmentation"])
def test_no_point_is_joined_and_frames_are_numbered_once(spark, sf_dir, name):
    """The driver keeps a plan of the last step only."""
    df = load_all()[name].run(spark, sf_dir)
    assert "Join" not in plan(df).split("Generate")[0]
    assert "row_number" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_made_once_and_not_sorted(spark, sf_dir, monkeypatch):
    a = both_ways(spark, sf_dir, monkeypatch, "h12_depth_units", ["demo_id", "t"])
    monkeypatch.undo()
    text_ = plan(load_all()["h12_depth_units"].run(spark, sf_dir))
    assert a.count() > 0 and "Generate" not in text_
    assert re.search(r"FlatMapGroupsInArrow(.*?)transform", text_, re.S) and "Sort" not in re.search(r"FlatMapGroupsInArrow(.*?)transform", text_, re.S).group(1)
