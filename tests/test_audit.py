from pathweave.operators.audit import Limits, audit

LIMITS = Limits(max_step=10.0, min_unique=0.6, min_inlier=0.9, max_changed=0.1, unit=1.0)
XYZ = "demo_id bigint, t bigint, point_id bigint, xu double, yu double, zu double"


def still(demo, frames=3, points=4, step=1.0):
    return [(demo, t, p, 5.0 * p + step * t, 0.0, 0.0) for t in range(frames) for p in range(points)]


def run(spark, tracks, counts, keys=((1, "traj"),), limits=LIMITS):
    demos = spark.createDataFrame([(k,) for k in sorted({c[0] for c in counts})], "demo_id bigint")
    rows = audit(demos, spark.createDataFrame(list(keys), "demo_id bigint, key_name string"), spark.createDataFrame(tracks, XYZ),
                 spark.createDataFrame(counts, "demo_id bigint, inlier_count bigint, changed_count bigint"), ["traj"], limits).collect()
    return {r.demo_id: r for r in rows}


def test_every_reason(spark):
    nan = [(2, 0, 0, 0.0, 0.0, 0.0), (2, 1, 0, float("nan"), 0.0, 0.0), (2, 2, 0, 1.0, 0.0, 0.0), (2, 0, 1, 9.0, 0.0, 0.0), (2, 1, 1, 11.0, 0.0, 0.0), (2, 2, 1, 12.0, 0.0, 0.0)]
    stacked = [(4, t, p, 50.0 * t, 0.0, 0.0) for t in range(2) for p in range(4)]
    tracks = [*still(1), *nan, *still(3, frames=1), *stacked, *still(6)]
    counts = [(1, 4, 0), (2, None, None), (3, 4, 0), (4, 2, 2), (5, 4, 0), (6, 4, 0)]
    got = run(spark, tracks, counts, keys=[(k, "traj") for k in range(1, 6)])
    assert [got[k].bad_reasons for k in range(1, 7)] == [
        "", "nonfinite;missing_filter_inlier_attr;missing_filter_changed_attr", "bad_shape",
        "max_step;low_unique0;low_inlier;too_many_replaced", "bad_shape", "missing:traj"]
    assert [got[k].is_bad for k in range(1, 7)] == [False] + [True] * 5
    assert [got[k].shape for k in range(1, 7)] == ["3x4x3", "3x2x3", "1x4x3", "2x4x3", "0x0x3", None]
    assert got[2].max_step == 2.0 and got[2].finite is False and got[1].unique0 == 4 and got[3].num_points is None


def test_counts_may_be_optional(spark):
    free = Limits(10.0, 0.6, 0.9, 0.1, 1.0, require_counts=False)
    got = run(spark, still(1), [(1, None, None)], limits=free)
    assert got[1].bad_reasons == "" and got[1].inlier_ratio is None
