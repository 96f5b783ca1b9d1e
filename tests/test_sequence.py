import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathweave.operators import segments as seg
from pathweave.operators.sequence import dense_index, first_n, over_neighbours, prefix, sparse_neighbour


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def series(n_demos=6, max_len=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(d, t, int(rng.integers(0, 2)), float(rng.normal())) for d in range(n_demos) for t in range(int(rng.integers(1, max_len)))]
    return pd.DataFrame(rows, columns=["demo_id", "t", "state", "x"])


def test_halo_window_equals_plain_window(spark):
    pdf = series()
    got = over_neighbours(frame(spark, pdf), ["demo_id"], "t", lambda w: {
        "nxt": F.lead("x").over(w), "prv": F.lag("x").over(w), "m": F.max("x").over(w.rowsBetween(-2, 2))}, before=2, after=2, size=4)
    got = got.toPandas().sort_values(["demo_id", "t"]).reset_index(drop=True)
    g = pdf.groupby("demo_id")["x"]
    want = pdf.assign(nxt=g.shift(-1), prv=g.shift(1), m=g.transform(lambda s: s.rolling(5, center=True, min_periods=1).max()))
    pd.testing.assert_frame_equal(got[["nxt", "prv", "m"]], want[["nxt", "prv", "m"]], check_dtype=False)


def test_prefix_carries_across_blocks(spark):
    pdf = series(seed=1)
    pdf["y"] = pdf["x"].where(pdf["state"] == 1)
    got = prefix(frame(spark, pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))), ["demo_id"], "t",
                 {"s": ("sum", "state"), "hi": ("max", "x"), "seen": ("last", "y")}, size=3)
    got = got.toPandas().sort_values(["demo_id", "t"]).reset_index(drop=True)
    g = pdf.groupby("demo_id")
    assert (got["s"].to_numpy() == g["state"].cumsum().to_numpy()).all()
    np.testing.assert_allclose(got["hi"], g["x"].cummax())
    np.testing.assert_allclose(got["seen"].astype(float), g["y"].ffill())


def test_sparse_neighbour_both_ways(spark):
    pdf = pd.DataFrame({"demo_id": [1] * 5 + [2], "t": [0, 3, 50, 51, 400, 7]})
    df = frame(spark, pdf)
    nxt = {r["t"]: r["n"] for r in sparse_neighbour(df, ["demo_id"], "t", "n", size=4).filter("demo_id = 1").collect()}
    prv = {r["t"]: r["n"] for r in sparse_neighbour(df, ["demo_id"], "t", "n", previous=True, size=4).filter("demo_id = 1").collect()}
    assert nxt == {0: 3, 3: 50, 50: 51, 51: 400, 400: None}
    assert prv == {0: None, 3: 0, 50: 3, 51: 50, 400: 51}


def test_dense_index_with_one_hot_key(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 9, 3000)), "v": rng.integers(0, 5000, 3000), "id": np.arange(3000)})
    got = dense_index(frame(spark, pdf), ["k"], ["v", "id"], [F.floor(F.col("v") / 512), F.col("v")], "pos").toPandas()
    want = pdf.sort_values(["k", "v", "id"]).assign(pos=lambda d: d.groupby("k").cumcount())
    assert got.set_index("id")["pos"].to_dict() == want.set_index("id")["pos"].to_dict()


def test_dense_index_never_broadcasts_its_offsets(spark, sf_dir):
    """Offsets may have as many rows as the table, while a compressed file looks small enough for the driver."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    got = dense_index(ev, ["user_id"], ["ts", "event_id"], [F.floor(sec / 86400), sec])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    n = got.count()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and n == ev.count()


def test_first_n_salted(spark):
    pdf = pd.DataFrame({"k": [0] * 500 + [1] * 3, "v": list(range(500, 0, -1)) + [9, 8, 7]})
    got = first_n(frame(spark, pdf), ["k"], [F.col("v")], 4, salts=7, salt_by=["v"]).orderBy("k", "rank").collect()
    assert [r["v"] for r in got] == [1, 2, 3, 4, 7, 8, 9]


def loop_changes(x, d):
    """Plain sequential statement of the rule: a change counts if the next d values that exist agree."""
    out, cur, i = [], x[0], 1
    while i < len(x):
        if x[i] == cur:
            i += 1
        elif all(v == x[i] for v in x[i:i + max(d, 1)]):
            out.append(i)
            cur = x[i]
            i += max(d, 1)
        else:
            i += 1
    return out


def test_debounce_equals_sequential_rule(spark):
    pdf = series(n_demos=120, max_len=30, seed=3)
    df = frame(spark, pdf)
    for d in (0, 1, 2, 3, 5):
        got = seg.debounced_changes(df, "state", d, size=8).filter("t > 0").toPandas()
        have = {k: sorted(g["t"]) for k, g in got.groupby("demo_id")}
        for k, g in pdf.groupby("demo_id"):
            assert have.get(k, []) == loop_changes(list(g["state"]), d), (k, d)


def test_segment_variants(spark):
    rows = [(1, t, 0) for t in range(5)]                                            # no change, short
    rows += [(2, t, 0 if t < 12 else 1) for t in range(20)]                         # one change
    rows += [(3, t, (t // 4) % 2) for t in range(16)]                               # only short stretches
    df = spark.createDataFrame(rows, "demo_id int, t int, state int")
    n = spark.createDataFrame([(1, 5), (2, 20), (3, 16), (4, 11)], "demo_id int, t_len int")

    def run(variant, **kw):
        return sorted(tuple(r) for r in seg.segments(df, "state", 2, 10, n, variant, **kw).collect())

    assert run("stage") == [(2, 0, 12), (3, 0, 16), (4, 0, 11)]
    assert run("viewer") == [(2, 0, 12)]
    assert run("training", keep_last=False) == [(1, 0, 5), (2, 0, 12)]
    assert (4, 0, 11) in run("inference") and (2, 12, 20) in run("inference")
    longer = n.withColumn("t_len", F.col("t_len") + 3)
    assert (2, 12, 23) in sorted(tuple(r) for r in seg.segments(df, "state", 2, 10, longer, "inference").collect())


def test_resample_is_monotone_and_keeps_ends(spark):
    df = spark.createDataFrame([(s, s + n) for s in (0, 7) for n in range(-1, 60)], "s int, e int")
    for k in (2, 5, 20):
        for r in df.select("s", "e", seg.resample_indices(F.col("s"), F.col("e"), k).alias("i")).collect():
            i = list(r["i"])
            assert len(i) == k and i == sorted(i) and i[0] == r["s"] and i[-1] == max(r["s"], r["e"])


def test_interval_join_counts(spark):
    rows = spark.range(0, 300).select(F.lit(1).alias("demo_id"), F.col("id").cast("int").alias("t"))
    iv = spark.createDataFrame([(1, 0, 10), (1, 60, 200), (1, 299, 300)], "demo_id int, s0 int, s1 int")
    assert seg.join_interval(rows, iv).count() == 10 + 140 + 1
