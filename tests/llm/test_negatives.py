import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathweave.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v int, slot string"


def brute(rows):
    """rows: (vec_id, embedding, label)."""
    seen = {}
    for i, e, c in rows:
        if i is None or c is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        c = (c + 1) % 10 if i % 7 == 0 else c
        v = [math.floor(256 * x) for x in e]
        if i not in seen or (c, v) < seen[i]:
            seen[i] = (c, v)
    out = []
    for a, (label, v) in seen.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, (c, w) in seen.items() if i != a)
        for p, i, c in [s for s in scores if s[2] == label][:5]:
            fits = [s for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def rows_of(df):
    return [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = got(queries.op13_negatives(spark, sf_dir))
    assert out == brute(rows_of(rows)) and out
    assert "op13_negatives" in entry.oracle_sql()


@pytest.mark.parametrize("block_bytes, part", [(3000, 2), (8 << 20, 1), (8 << 20, 1000)])
def test_blocks_and_bounds_change_nothing(spark, block_bytes, part):
    rng = np.random.default_rng(4)
    # few values, so that scores tie and limits repeat; one label holds most rows
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4) / 4], int(rng.choice([1, 1, 1, 2, 3]))) for i in range(900)]
    df = spark.createDataFrame([(*r, "a", 0, "b") for r in rows], SCHEMA).repartition(5)
    assert got(negatives.mine(df, F.col("vec_id") % 100 == 0, block_bytes=block_bytes, part=part)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, nan], 1), (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (6, None, 2), (8, [0.5, 1.0], None),
            (9, [0.5, 1.1], 2), (9, [0.5, 1.1], 2), (9, [0.6, 1.1], 2), (10, [], 3), (11, [0.9], 3), (12, [0.5, 1.1], 4), (None, [1.0, 1.0], 2), (100, [-1.0, 0.0], 1),
            (200, [1e30, 1e30], 5), (201, [1e30, 2e30], 5), (203, [8e29, 8e29], 6), (300, [0.0, 0.0], 7), (301, [0.0, 0.0], 7)]
    df = spark.createDataFrame([(*r, "a", 0, "b") for r in rows], SCHEMA)
    out = got(negatives.mine(df, F.col("vec_id") % 100 == 0))
    want = [r for r in brute(rows) if r[0] != 200]
    assert [r for r in out if r[0] != 200] == want and {r[0] for r in out} >= {0, 300}
    assert got(negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert got(negatives.mine(df.filter("vec_id < 9"), F.lit(False))) == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 10**5, 10**7):
        a, b = rng.integers(-size, size, (5, 64)), rng.integers(-size, size, (7, 64))
        assert (negatives.products(a.astype(float), b.astype(float)) == a @ b.T).all()
    assert negatives.products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))[0, 0] == 2**63 - 1
