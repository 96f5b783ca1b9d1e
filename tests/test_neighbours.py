import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathweave.operators import filters as flt
from pathweave.operators import neighbours
from pathweave.operators.neighbours import component_labels, knn, largest_component
from pathweave.plans.filters import knn_self

XYZ = ["xu", "yu", "zu"]


def cloud(seed, n=70):
    """A tight cluster, a wide scatter and many copies of one point."""
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.integers(0, 30, (n, 3)), rng.integers(0, 5000, (n // 2, 3)), np.full((n, 3), 77)])
    return pd.DataFrame(p, columns=XYZ).assign(g=seed, point_id=np.arange(len(p)))


def brute(pdf, k):
    out = {}
    p, ids = pdf[XYZ].to_numpy(float), pdf["point_id"].to_numpy()
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(axis=1)
        order = sorted((d[j], int(ids[j])) for j in range(len(p)) if j != i)[:k]
        out[int(ids[i])] = order
    return out


@pytest.mark.parametrize("limit", [4096, 0])
def test_knn_matches_brute_force(spark, limit):
    pdf = pd.concat([cloud(1), cloud(2, 20)])
    got = knn(spark.createDataFrame(pdf), ["g"], "point_id", XYZ, 5, frame_limit=limit).collect()
    assert len(got) == len(pdf)
    for g, part in pdf.groupby("g"):
        want = brute(part, 5)
        for r in (r for r in got if r["g"] == g):
            assert [(x["d2"], x["point_id"]) for x in r["nn"]] == want[r["point_id"]]


def test_query_measures_its_frames(spark, monkeypatch):
    """j07: a frame beyond the limit, here of 100 points, goes through the grid, not into one row."""
    split, sizes = neighbours._split_by_size, []

    def measured(df, keys, limit):
        small, large = split(df, keys, 100)
        sizes.append((small.count(), large.count()))
        return small, large

    monkeypatch.setattr(neighbours, "_split_by_size", measured)
    pdf = pd.concat([cloud(1), cloud(2, 20)]).rename(columns={"g": "demo_id"}).assign(t=0)

    class Frames:
        def tracks(self):
            return spark.createDataFrame(pdf)

    got = {(r.demo_id, r.point_id): r.mean_knn for r in knn_self(Frames()).collect()}
    assert sizes == [(50, 175)] and len(got) == len(pdf)
    for g, part in pdf.groupby("demo_id"):
        assert all(abs(got[g, i] - np.mean([d**0.5 for d, _ in near])) < 1e-5 for i, near in brute(part, 5).items())


def test_component_routes_agree(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 400, (150, 3)), columns=XYZ).assign(g=1, point_id=np.arange(150), thr=60.0)
    pdf = pd.concat([pdf, cloud(2, 30).assign(thr=9.0)])
    df = spark.createDataFrame(pdf)
    a = largest_component(df, ["g"], "point_id", XYZ, "thr").toPandas()
    b = largest_component(df, ["g"], "point_id", XYZ, "thr", frame_limit=0).toPandas()
    for res in (a, b):
        for g, part in pdf.groupby("g"):
            lab = part["point_id"].to_numpy()[component_labels(part[XYZ].to_numpy(float), part["thr"].iloc[0])]
            own = res[res["g"] == g].set_index("point_id").loc[part["point_id"]]
            same = own["component"].to_numpy()
            assert (pd.factorize(same)[0] == pd.factorize(lab)[0]).all()
            vals, n = np.unique(lab, return_counts=True)
            assert own["in_largest"].sum() == n.max()


def tracks(spark, T=12, N=16, islands=3, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 200, (N, 3))
    base[:islands] += 5000
    rows = [(d, t, p, *(int(v) for v in base[p] + 3 * t)) for d in (1, 2) for t in range(T) for p in range(N)]
    return spark.createDataFrame(rows, "demo_id bigint, t int, point_id bigint, xu bigint, yu bigint, zu bigint")


def test_component_filter_finds_islands_and_keeps_enough(spark):
    tr = tracks(spark)
    cand = tr.filter("t = 0").select("demo_id", "point_id")
    bad = flt.component_filter(tr, cand, k=4, factor=6.0).filter("bad").toPandas()
    assert set(bad["point_id"]) == {0, 1, 2} and len(bad) == 6
    # two equal halves: the larger component would keep 8 of 16 points, fewer than the guard asks for
    halves = tr.withColumn("xu", F.when(F.col("point_id") < 8, F.col("xu") % 200).otherwise(F.col("xu") % 200 + 900000))
    halves = halves.withColumns({"yu": F.col("yu") % 200, "zu": F.col("zu") % 200})
    assert flt.component_filter(halves, cand, k=4, factor=6.0).filter("bad").count() == 0


def test_trajectory_distances_are_block_sums(spark):
    tr = tracks(spark, T=9)
    got = flt.trajectory_distances(tr, size=4).filter("demo_id = 1").toPandas().set_index(["i", "j"])["d2"]
    p = tr.filter("demo_id = 1").orderBy("point_id", "t").toPandas()
    m = np.stack([p[c].to_numpy(float).reshape(16, 9) for c in XYZ], axis=2)
    for i, j in ((0, 1), (2, 9), (14, 15)):
        assert np.isclose(got[(i, j)], ((m[i] - m[j]) ** 2).sum(), rtol=1e-9)


def test_donor_copy_replaces_whole_tracks(spark):
    tr = tracks(spark)
    f = tr.filter("t = 0").withColumn("inlier", F.col("point_id") >= 3)
    out = flt.copy_tracks(tr, flt.nearest_donor(f, "inlier"))
    assert out.count() == tr.count()
    assert out.filter("xu > 4000").count() == 0


def test_donors_of_demos_without_inliers_or_positions(spark):
    rows = [(1, 1, 0.0, True), (1, 2, 10.0, True), (1, 3, 5.0, False), (1, 4, None, False), (1, 5, float("nan"), True),  # 3: a tie
            (2, 1, 0.0, False), (3, 1, 0.0, True)]
    p = spark.createDataFrame(rows, "demo_id bigint, point_id bigint, xu double, inlier boolean").withColumns({"yu": F.lit(1), "zu": F.lit(2)})
    assert [tuple(r) for r in flt.nearest_donor(p, "inlier").collect()] == [(1, 3, 1, 25.0)]
    chosen = {(r["demo_id"], r["point_id"]): r["donor"] for r in flt.random_donor(p, "inlier").collect()}
    assert chosen.keys() == {(1, 3), (1, 4)} and set(chosen.values()) <= {1, 2, 5}
    assert flt.nearest_donor(p.filter("false"), "inlier").count() == 0 and flt.random_donor(p.filter("false"), "inlier").count() == 0


def test_donors_of_packed_demos_are_those_of_tiles(spark, monkeypatch):
    """Small demos need no tiles; demos above the limit go through them, with the same donors, distances and ties."""
    rng = np.random.default_rng(4)
    rows = [(d, i, *(float(x) for x in rng.integers(0, 4, 3)), bool(i % 3 == d % 3)) for d in range(6) for i in range(5 + 9 * d)]
    p = spark.createDataFrame(rows, "demo_id bigint, point_id bigint, xu double, yu double, zu double, inlier boolean").repartition(3)
    want = {}
    for d, i, x, y, z, inlier in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, j) for e, j, a, b, c, give in rows if e == d and give)
        if near and not inlier:
            want[(d, i)] = near[0]
    for limit in (0, 20):
        assert {(r["demo_id"], r["point_id"]): (r["d2"], r["donor"]) for r in flt.nearest_donor(p, "inlier", limit).collect()} == want
    monkeypatch.setattr(flt, "nearest", None)
    assert {(r["demo_id"], r["point_id"]): (r["d2"], r["donor"]) for r in flt.nearest_donor(p, "inlier").collect()} == want


def test_random_donors_are_spread(spark):
    p = spark.range(4000).select(F.lit(1).cast("bigint").alias("demo_id"), F.col("id").alias("point_id"), (F.col("id") % 4 == 0).alias("inlier"))
    out = flt.random_donor(p, "inlier").toPandas()
    assert len(out) == 3000 and (out["donor"] % 4 == 0).all() and out["donor"].nunique() > 900


def test_a_point_alone_has_no_mean_distance(spark):
    one = spark.createDataFrame([(1, 1, 0, 0, 0)], "g bigint, point_id bigint, xu bigint, yu bigint, zu bigint")
    assert [r[0] for r in knn(one, ["g"], "point_id", XYZ, 3).select(neighbours.knn_mean(F.col("nn"))).collect()] == [None]
