import numpy as np
from pyspark.sql import functions as F

from pathweave.operators import calibration as cal
from pathweave.plans.calibration import correspondences, score_hypotheses
from pathweave.plans.fixtures import Data


def test_every_reason_to_refuse_a_segment(spark):
    rows = [(23, 23, 1.0, 0.0, "too_few_corr"), (24, 0, None, None, "degenerate"), (24, 11, 1.0, 0.0, "too_few_inliers"),
            (100, 34, 1.0, 0.0, "low_inlier_ratio"), (100, 35, 0.09, 0.0, "scale_out_of_range"), (100, 35, 10.1, 99.0, "scale_out_of_range"),
            (100, 35, 0.1, 60.1, "residual_p95_too_large"), (100, 35, 10.0, 60.0, ""), (24, 12, 1.0, 0.0, ""), (0, 0, None, None, "too_few_corr")]
    df = spark.createDataFrame(rows, "n_corr int, n_inliers int, scale double, inlier_p95 double, want string")
    got = df.select("want", cal.stage_reason(24, 12, 0.35, (0.1, 10.0), 60.0)).collect()
    assert [tuple(r) for r in got] == [(r[-1], r[-1]) for r in rows]


def test_gates(spark):
    rows = [(1, 0, 1, 1.0, 1), (1, 1, 1, 1.0, 1), (1, 2, 1, 1.0, 0), (1, 4, 1, 1.0, None), (1, 6, 2, 1.0, 1), (1, 8, 1, float("inf"), 1), (2, 0, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "demo_id bigint, t int, point_id bigint, sx double, vis int")
    df = df.withColumns({c: F.lit(0.0) for c in (*cal.SRC[1:], *cal.DST)})
    ok = spark.createDataFrame([(1, 1), (1, 1), (2, 9)], "demo_id bigint, point_id bigint")
    # frame 1 is off the stride, 2 is hidden, point 2 is not steady, 8 is not finite; unknown visibility passes
    assert sorted(r["t"] for r in cal.gate(df, ok, 2).collect()) == [0, 4]


def similarity(x, y):
    """Least-squares scale, rotation and shift by the covariance's singular vectors."""
    mx, my = x.mean(0), y.mean(0)
    u, s, vt = np.linalg.svd((y - my).T @ (x - mx) / len(x))
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    rot = u @ np.diag(sign) @ vt
    scale = (s * sign).sum() / ((x - mx) ** 2).sum(1).mean()
    return scale, rot, my - scale * rot @ mx


def test_hypotheses_are_judged_on_all_rows(spark, sf_dir):
    d = Data(spark, sf_dir)
    rows = correspondences(d, vis=False).withColumn("h", F.pmod(F.xxhash64("demo_id", "t", "point_id"), F.lit(8))).toPandas()
    got = {(r.demo_id, r.h): r for r in score_hypotheses(d).collect()}
    assert len(got) == len(rows[["demo_id", "h"]].drop_duplicates())
    for demo, part in rows.groupby("demo_id"):
        x, y = part[list(cal.SRC)].to_numpy(float), part[list(cal.DST)].to_numpy(float)
        for h in part["h"].unique():
            own = (part["h"] == h).to_numpy()
            scale, rot, shift = similarity(x[own], y[own])
            err = np.linalg.norm(scale * x @ rot.T + shift - y, axis=1)
            r = got[demo, h]
            assert r.n == len(part) and abs(r.n_inliers - (err <= 9000).sum()) <= np.isclose(err, 9000, rtol=1e-9).sum()
            assert np.isclose(r.median_err, np.median(err), rtol=1e-6, atol=1e-5)
