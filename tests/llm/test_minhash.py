import random
import re
from collections import Counter

import numpy as np

from pathweave.llm import minhash
from pathweave.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values())


def brute(rows):
    """class_id per doc_id from all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in rows if i is not None}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, b in bags.items():
        for s in b:
            where.setdefault(s, []).append(i)
    for i, j in {(i, j) for ids in where.values() for i in ids for j in ids if i < j}:
        if alike(bags[i], bags[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in bags}


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect() if r.doc_id is not None}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = classes(minhash.near_duplicates(docs))
    assert got == want and len(set(want.values())) < 0.95 * len(want)


def test_odd_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(edge_docs)
    assert got.count() == len(rows) and classes(got) == brute(rows)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(edge_docs, no_docs):
    kept = minhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, None], key=str)
    assert minhash.keep_one(no_docs).count() == 0


def test_large_group_of_different_near_copies(make_docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]

    def copy():
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        return " ".join(w)

    rows = [(i, copy()) for i in range(150)] + [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for i in range(20)]
    got = classes(minhash.near_duplicates(make_docs(rows)))
    assert {got[i] for i in range(150)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    for share in (0.3, 0.8):
        a, b = rng.uniform(0.2, 6, 300), None
        b = np.where(rng.random(300) < share, a, a * rng.uniform(0, 1.5, 300))
        keep = b > 0
        got = minhash.signatures([(elements, a), (elements[keep], b[keep])], 2000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + rng.randrange(max(1, i))) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(60)) and len(got) == 261
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
