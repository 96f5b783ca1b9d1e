import numpy as np
from pyspark.sql import functions as F

from pathweave.operators.metric import meeting_tiles, nearest


def brute(rows, k):
    out = {}
    for g, i, v in rows:
        other = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for h, j, w in rows if h == g and j != i)
        if other:
            out[(g, i)] = other[:k]
    return out


def got(df):
    return {(r["g"], r["id"]): [(n["d2"], n["id"]) for n in r["nn"]] for r in df.collect()}


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    # clusters far apart, equal points, a tiny group and a single point
    rows = [(1, i, [float(x) for x in rng.integers(0, 40, 12) + 10_000 * (i % 5)]) for i in range(400)]
    rows += [(2, i, [float(i % 3)] * 12) for i in range(60)] + [(3, 1, [0.0] * 12), (3, 2, [1.0] * 12), (4, 9, [5.0] * 12)]
    df = spark.createDataFrame(rows, "g int, id bigint, v array<double>").repartition(4)
    want = brute(rows, 4)
    for tile in (7, 40, 1024):
        assert got(nearest(df, ["g"], "id", "v", 4, tile=tile)) == want
    assert got(nearest(df.limit(0), ["g"], "id", "v", 4)) == {}


def test_two_sets_equal_brute_force(spark):
    """Askers far from every giver, ties, points of both or no role, groups without givers."""
    rng = np.random.default_rng(5)
    rows = [(1, i, [float(x) for x in rng.integers(0, 9, 3) + (50_000 if i % 11 == 0 else 0)], i % 3 == 0, i % 3 != 0) for i in range(330)]
    rows += [(2, i, [0.1 * i] * 3, i < 3, i in (2, 5)) for i in range(7)] + [(3, 1, [0.0] * 3, True, False), (4, 1, [1.0] * 3, False, True)]
    df = spark.createDataFrame(rows, "g int, id bigint, v array<double>, a boolean, b boolean").repartition(3)
    want = {}
    for g, i, v, ask, _ in rows:
        near = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for h, j, w, _, give in rows if h == g and give and j != i)[:2]
        if ask and near:
            want[(g, i)] = near
    for tile in (5, 1024):
        found = got(nearest(df, ["g"], "id", "v", 2, tile=tile, ask="a", give="b"))
        assert found.keys() == want.keys()
        assert all(np.allclose([d for d, _ in found[x]], [d for d, _ in want[x]], rtol=1e-14) and [i for _, i in found[x]] == [i for _, i in want[x]] for x in want)


def test_distances_do_not_suffer_from_far_origins(spark):
    rows = [(1, i, [1e9 + 0.25 * i, 1e9]) for i in range(20)]
    assert got(nearest(spark.createDataFrame(rows, "g int, id bigint, v array<double>"), ["g"], "id", "v", 2, tile=6)) == brute(rows, 2)


def test_tiles_out_of_reach_do_not_meet(spark):
    """Ten tiles on a line with the pivots 0 and 1000: a tile meets those whose ranges its bound reaches."""
    tiles = spark.range(10).select(
        F.lit(1).alias("g"), F.col("id").alias("tile"), F.array(F.col("id") * 100.0, 910.0 - F.col("id") * 100).alias("low"),
        F.array(F.col("id") * 100.0 + 90, 1000.0 - F.col("id") * 100).alias("high"), F.lit(5).alias("n_ask"), F.lit(5).alias("n_give"),
        F.when(F.col("id") == 9, float("inf")).otherwise(20.0).alias("bound"))
    met = {(r["tile"], r["other"]) for r in meeting_tiles(tiles, ["g"], 3).collect()}
    assert {p for p in met if p[0] < 9} == {(a, b) for a in range(9) for b in (a - 1, a + 1) if 0 <= b <= 9}
    assert {b for a, b in met if a == 9} < set(range(9)) and (9, 8) in met  # no neighbours yet: the ranges of the others bound it
    few = meeting_tiles(tiles.withColumn("n_give", F.lit(2)), ["g"], 3)
    assert few.filter("tile = 9").count() == 9  # tiles of too few points bound nothing
