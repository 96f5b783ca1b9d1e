import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathweave.functions import geometry as geo
from pathweave.operators import calibration as cal
from pathweave.operators.lifting import choose_nearest, temporal_patch
from pathweave.session import scratch_dir
from pathweave.streaming import processors as proc
from pathweave.streaming.sources import run_to_table


def planted(n=400, noise=0.01, outliers=0.0, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rot = q * np.sign(np.linalg.det(q))
    x = rng.normal(size=(n, 3))
    y = 1.7 * x @ rot.T + [1.0, -2.0, 0.5] + rng.normal(scale=noise, size=(n, 3))
    bad = rng.random(n) < outliers
    y[bad] += rng.normal(scale=20, size=(bad.sum(), 3))
    return x, y, rot


def corr(spark, x, y):
    pdf = pd.DataFrame(np.hstack([x, y]), columns=[*cal.SRC, *cal.DST]).assign(demo_id=1, i=np.arange(len(x)))
    return spark.createDataFrame(pdf)


def test_fit_from_moments(spark):
    x, y, rot = planted()
    f = cal.fit_sim3(corr(spark, x, y), ["demo_id"]).first()
    assert abs(f["scale"] - 1.7) < 2e-3
    np.testing.assert_allclose(np.array(f["rot"]).reshape(3, 3), rot, atol=2e-3)
    np.testing.assert_allclose(f["trans"], [1.0, -2.0, 0.5], atol=5e-3)
    a = cal.fit_affine(corr(spark, x, y), ["demo_id"]).first()
    np.testing.assert_allclose(np.array(a["a"]).reshape(3, 3).T, 1.7 * rot, atol=5e-3)


def test_degenerate_groups_have_no_fit(spark):
    same = np.ones((10, 3))
    assert cal.fit_sim3(corr(spark, same, same), ["demo_id"]).first()["scale"] is None
    x, y, _ = planted(2)
    assert cal.fit_sim3(corr(spark, x, y), ["demo_id"]).first()["scale"] is None


def test_ransac_and_trim_resist_outliers(spark):
    x, y, rot = planted(outliers=0.3, seed=3)
    r = cal.ransac_sim3(corr(spark, x, y), ["demo_id"], ["i"], iterations=128, threshold=0.1).first()
    assert abs(r["scale"] - 1.7) < 5e-3 and 0.6 < r["n_inliers"] / r["n_corr"] < 0.8
    x, y, _ = planted(outliers=0.04, seed=4)
    t = cal.trimmed_fit(corr(spark, x, y), ["demo_id"]).first()
    plain = cal.fit_sim3(corr(spark, x, y), ["demo_id"]).first()
    assert abs(t["scale"] - 1.7) < abs(plain["scale"] - 1.7) and t["n"] < 400


def test_ransac_uses_every_correspondence_of_a_large_group(spark):
    x, y, rot = planted(120_000, outliers=0.4, seed=5)
    r = cal.ransac_sim3(corr(spark, x, y), ["demo_id"], ["i"], iterations=64, threshold=0.1).first()
    assert r["n_corr"] == 120_000 and abs(r["n_inliers"] - 72_000) < 1_500
    np.testing.assert_allclose(np.array(r["rot"]).reshape(3, 3), rot, atol=1e-3)


def test_scores_equal_a_loop_over_hypotheses(spark):
    x, y, _ = planted(300, outliers=0.3, seed=6)
    c = corr(spark, x, y)
    hyps = cal.hypotheses(c, ["demo_id"], ["i"], 40).cache()
    h = hyps.first()
    got = {r["h"]: r["n_in"] for r in cal.score(c, hyps, ["demo_id"], ["i"], 0.2).collect()}
    for k in range(40):
        pred = h["hs"][k] * x @ np.array(h["hr"][9 * k:9 * k + 9]).reshape(3, 3).T + np.array(h["ht"][3 * k:3 * k + 3])
        assert got[k] == (np.linalg.norm(pred - y, axis=1) <= 0.2).sum()
    assert max(got.values()) > 150


def test_one_product_decides_like_plain_residuals():
    rng = np.random.default_rng(8)
    x, y, rot = planted(3000, outliers=0.5, seed=9)
    x, y = x * 1000 + 50_000, y * 1000 - 90_000
    scale, turn, trans = rng.normal(1.7, 0.1, 40), np.repeat(rot[None], 40, axis=0), rng.normal(size=(40, 3)) * 1000
    plain = ((scale[:, None, None] * np.einsum("hij,nj->hni", turn, x) + trans[:, None] - y) ** 2).sum(2)
    limit = float(np.sqrt(np.median(plain)))
    assert (cal.inliers(x, y, scale, turn, trans, limit) == (plain <= limit**2)).mean() > 1 - 1e-5
    exact = cal.inliers(np.array([[1.0, 0, 0]] * 2), np.array([[4.0, 0, 0], [4.0, 1e-7, 0]]), np.ones(1), np.eye(3)[None], np.zeros((1, 3)), 3.0)
    assert exact.tolist() == [[True, False]]


def test_draws_are_different_rows():
    for pool in (3, 4, 5, 7, 100, 2048):
        at = cal.draw_positions(pool, 200, 1)
        assert all(len(set(row)) == min(4, pool) for row in at.tolist()) and at.max() < pool


def test_tiny_and_degenerate_groups(spark):
    x, y, _ = planted(2)
    assert cal.ransac_sim3(corr(spark, x, y), ["demo_id"], ["i"], 16, 0.1).first()["scale"] is None
    same = np.ones((10, 3))
    r = cal.ransac_sim3(corr(spark, same, same), ["demo_id"], ["i"], 16, 0.1).first()
    assert r["scale"] is None and r["n_corr"] == 10


def test_trim_stops_when_too_few_would_stay(spark):
    x, y, _ = planted(20)
    assert cal.trimmed_fit(corr(spark, x, y), ["demo_id"], percentile=0.5, min_points=16).first()["n"] == 20


def test_unproject_project_identity(spark):
    df = spark.range(50).select((F.col("id") * 3.7).alias("u"), (F.col("id") * 1.3 + 2).alias("v"), (F.col("id") + 1.5).alias("z"))
    k = [F.lit(v) for v in (120.0, 110.0, 64.0, 60.0)]
    u, v = geo.project(*k, geo.unproject(*k, F.col("u"), F.col("v"), F.col("z")))
    assert df.select(F.max(F.abs(u - F.col("u")) + F.abs(v - F.col("v")))).first()[0] < 1e-9


def test_holes_in_the_depth_do_not_end_the_walk(spark):
    none = ([],) * 5
    one = ([1.0], [2.0], [3.0], [3.0], [0.5])
    rows = [(1, 1, 0, *none), (1, 1, 1, *one), (1, 1, 2, *none), (1, 1, 3, *one)]
    df = spark.createDataFrame(rows, "demo_id bigint, point_id bigint, t int, cx array<double>, cy array<double>, cz array<double>, z array<double>, pd array<double>")
    got = {r["t"]: r["x"] for r in temporal_patch(df, 0.01, 0.2).collect()}
    assert got[1] == got[3] == 1.0 and got[0] is None and got[2] is None
    with_own = df.withColumns({b: F.lit(9.0) for b in ("bx", "by", "bz")})
    assert {r["t"]: r["x"] for r in temporal_patch(with_own, 0.01, 0.2).collect()} == {0: 9.0, 1: 1.0, 2: 9.0, 3: 1.0}


def candidates(spark, tracks=4, frames=30, least=1, step=1):
    rng = np.random.default_rng(7)
    rows = []
    for p in range(tracks):
        for t in range(0, frames * step, step):
            n = int(rng.integers(least, 9))
            c = rng.normal(size=(5, n)) + 5
            rows.append((1, p, t, *[list(map(float, r)) for r in c]))
    return spark.createDataFrame(rows, "demo_id bigint, point_id bigint, t int, cx array<double>, cy array<double>, cz array<double>, z array<double>, pd array<double>")


def walked(df):
    want = {}
    for (p,), g in df.toPandas().groupby(["point_id"]):
        prev = None
        for r in g.sort_values("t").itertuples():
            xyz = np.stack([r.cx, r.cy, r.cz], axis=1)
            prev = xyz[choose_nearest(prev, xyz, np.array(r.z), np.array(r.pd), 0.01, 0.2)] if len(xyz) else None
            want[(p, r.t)] = (None,) * 3 if prev is None else tuple(prev)
    return want


def test_long_tracks_with_holes_and_gaps_are_composed_by_blocks(spark):
    # blocks of 4 of blocks of 4: four levels, with holes, missing frames and block borders inside them
    df = candidates(spark, tracks=2, frames=300, least=0, step=3).filter("t % 7 <> 0").cache()
    want = walked(df)
    assert any(v[0] is None for v in want.values())
    for block in (4, 256):
        assert {(r["point_id"], r["t"]): (r["x"], r["y"], r["z"]) for r in temporal_patch(df, 0.01, 0.2, block=block).collect()} == want
    assert temporal_patch(df.limit(0), 0.01, 0.2).count() == 0


def test_temporal_choice_batch_stream_and_loop_agree(spark):
    df = candidates(spark)
    batch = {(r["point_id"], r["t"]): (r["x"], r["y"], r["z"]) for r in temporal_patch(df, 0.01, 0.2).collect()}
    want = {}
    for (p,), g in df.toPandas().groupby(["point_id"]):
        prev = None
        for r in g.sort_values("t").itertuples():
            xyz = np.stack([r.cx, r.cy, r.cz], axis=1)
            prev = xyz[choose_nearest(prev, xyz, np.array(r.z), np.array(r.pd), 0.01, 0.2)]
            want[(p, r.t)] = tuple(prev)
    assert batch == want
    folder = scratch_dir(spark, "cands")
    for lo in (0, 10, 20):  # three files arrive one after the other
        df.filter(F.col("t").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run_to_table(proc.temporal_patch(s, 0.01, 0.2), "patch")
    assert {(r["point_id"], r["t"]): (r["x"], r["y"], r["z"]) for r in out.collect()} == want
