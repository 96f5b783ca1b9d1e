import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathweave.functions import arrays as arr
from pathweave.functions.numeric import all_finite, is_finite, r6, round_half_even
from pathweave.functions import text as tx
from pathweave.operators.quantile import exact_mad, exact_quantiles, robust_limits


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x")).collect()] == [0.0, 2.0, 2.0, 0.0]
    assert str(spark.range(1).select(r6(F.lit(-1e-9))).first()[0]) == "0.0"


def test_finite_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0)], "a double, b double")
    assert df.filter(all_finite(["a", "b"])).count() == 1
    assert df.filter(is_finite("b")).count() == 3


def test_lower_and_plain_median(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],)], "a array<double>")
    r = df.select(arr.lower_median(F.col("a")), arr.quantile(F.col("a"), 0.5), arr.quantile(F.col("a"), 0.95)).first()
    np.testing.assert_allclose(tuple(r), (2.0, 2.5, 8.95), rtol=1e-12)


def test_robust_upper_fallbacks(spark):
    df = spark.createDataFrame([([5.0] * 9 + [50.0],), ([1.0, 2.0, 3.0, 4.0, 100.0],), ([],)], "a array<double>")
    got = {k: [r[0] for r in df.select(arr.robust_upper(F.col("a"), 3.0, k)).collect()] for k in ("mean", "iqr", "margin")}
    v = np.array([5.0] * 9 + [50.0])
    assert np.isclose(got["mean"][0], v.mean() + 3 * (v.std() + 1e-12))
    assert got["iqr"][0] == 50.0 and np.isclose(got["margin"][0], 5.0 + 1e-6)
    assert np.isclose(got["iqr"][1], 3.0 + 3 * 1.4826 * 1.0)
    assert got["mean"][2] == float("inf")


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1e3, 500), np.zeros(300), rng.integers(-3, 3, 400).astype(float), [1e12, -1e-9]])
    pdf = pd.DataFrame({"k": np.where(np.arange(len(v)) % 3 == 0, 0, np.arange(len(v)) % 7), "v": v})
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    low = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"m": 0.5}, disc=True).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.percentile(g["v"], [0, 25, 50, 95, 100]), rtol=1e-12)
        assert low.loc[k, "m"] == np.sort(g["v"])[(len(g) - 1) // 2]
    whole = exact_quantiles(spark.createDataFrame(pdf), [], "v", {"m": 0.5}).first()
    assert np.isclose(whole["m"], np.median(v))


def test_selection_narrows_crowded_buckets(spark):
    rng = np.random.default_rng(6)
    # one hot group of a constant plus noise (one bucket holds nearly all), equal values, infinities, tiny and negative numbers
    groups = {0: 7.0 + rng.normal(0, 1e-9, 4000), 1: np.repeat([3.0, 3.0 + 1e-15, -3.0], 200), 2: np.array([np.inf, -np.inf, 1.0, 2.0, 3.0]),
              3: np.array([5e-324, 1e-323, -5e-324, 0.0]), 4: np.array([1.0]), 5: np.nextafter(1.0, 2.0) * np.ones(9)}
    df = spark.createDataFrame(pd.DataFrame([(k, float(x)) for k, v in groups.items() for x in v], columns=["k", "v"]))
    df = df.unionByName(spark.createDataFrame([(0, None), (6, None), (4, float("nan"))], "k bigint, v double"))
    probs = {"a": 0.02, "b": 0.5, "c": 0.51, "d": 0.98}
    for limit in (1, 64, 1 << 16):
        got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, limit=limit).collect()}
        low = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}, disc=True, limit=limit).collect()}
        assert set(got) == set(low) == set(groups)
        for k, v in groups.items():
            assert low[k] == np.sort(v)[(len(v) - 1) // 2]
            if k != 2:
                np.testing.assert_allclose([got[k][c] for c in probs], np.quantile(v, list(probs.values())), rtol=1e-15, atol=1e-323)
        assert got[2].b == 2.0
    assert exact_quantiles(df.filter("false"), ["k"], "v", probs).collect() == []


def test_median_absolute_deviation(spark):
    rng = np.random.default_rng(7)
    v = {k: 5.0 + rng.normal(0, 10.0 ** -k, 50 + k) for k in range(4)}
    df = spark.createDataFrame(pd.DataFrame([(k, x) for k, xs in v.items() for x in xs], columns=["k", "v"]))
    for r in exact_mad(df, ["k"], "v", limit=8).collect():
        assert np.isclose(r.med, np.median(v[r.k]), rtol=1e-14) and np.isclose(r.mad, np.median(np.abs(v[r.k] - np.median(v[r.k]))), rtol=1e-12)


def test_limits_of_groups_equal_those_of_arrays(spark):
    rng = np.random.default_rng(3)
    values = {1: rng.normal(5, 2, 101), 2: [5.0] * 9 + [50.0], 3: [1.0, 2.0, 3.0, 4.0, 100.0], 4: [7.0], 5: [2.0] * 6 + [3.0] * 4,
              6: [float("nan"), float("inf"), 1.0, 4.0], 7: [float("nan"), None], 8: [None]}
    df = spark.createDataFrame([(k, None if x is None else float(x)) for k, xs in values.items() for x in xs], "k int, v double")
    packed = df.groupBy("k").agg(F.collect_list("v").alias("a"))
    for kind in ("mean", "iqr", "margin", "floor"):
        want = {r[0]: r[1] for r in packed.select("k", arr.robust_upper(F.col("a"), 3.0, kind)).collect()}
        got = {r[0]: r[1] for r in robust_limits(df, ["k"], "v", 3.0, kind, limit=4).collect()}
        assert got.keys() == want.keys() and got[8] == float("inf")
        np.testing.assert_allclose([got[k] for k in values], [want[k] for k in values], rtol=1e-12)
    assert robust_limits(df.filter("false"), ["k"], "v", 3.0, "iqr").collect() == []


def test_names(spark):
    df = spark.createDataFrame([("KITCHEN_SCENE3_pick_up_the_red_cup_demo_tracks",), ("Put the two bowls onto the plate, and then wait.",)], "s string")
    a, b = df.select(tx.normalize_instruction(F.col("s")), tx.object_phrase(F.col("s"))).collect()
    assert a[0] == "pick up the red cup" and b[1] == "two bowls"
    long = spark.range(1).select(tx.dirname(F.lit("lift " * 60))).first()[0]
    assert len(long) <= 120 and len(long.rsplit("_", 1)[1]) == 8
    ids = spark.createDataFrame([("demo_10",), ("demo_2",), ("x",), ("2",)], "s string")
    assert [r[0] for r in ids.orderBy(*tx.natural_key(F.col("s"))).collect()][:3] == ["2", "demo_2", "demo_10"]
