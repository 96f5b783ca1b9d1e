import hashlib
import random

import pytest

from pathweave.llm import substring


def brute(rows, size=20):
    """Rows are (doc_id, text); equal rows are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for doc in docs:
        w = (doc[1] or "").encode().split()
        gone = set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone.update(range(s, s + size))
            seen.add(key)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (doc[0], len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("group", [substring.GROUP, 2])
def test_whole_table_equals_brute_force(spark, group):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert rows(substring.remove_repeats(docs, group=group)) == want
    assert any(0 < r[2] < r[1] for r in want)


@pytest.mark.parametrize("group", [substring.GROUP, 3])
def test_passages_and_periods(make_docs, group):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]

    def some(n):
        return [f"r{rng.randrange(40)}" for _ in range(n)]

    texts = [" ".join(some(rng.randrange(80)) + passage[rng.randrange(20) : rng.randrange(25, 60)] + some(rng.randrange(60))) for _ in range(60)]
    texts += ["a b c " * 30, "a b c " * 50, "b c a " * 9, " ".join(passage), " ".join(passage), " ".join(passage[:20]), " ".join(passage[:19]), "a " * 400]
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    assert rows(substring.remove_repeats(make_docs(docs), group=group)) == brute(docs)


def test_odd_rows(edge_docs, no_docs, make_docs):
    edge = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert rows(substring.remove_repeats(edge_docs)) == brute(edge)
    assert rows(substring.remove_repeats(no_docs)) == []
    long = " ".join(f"w{i}" for i in range(50))
    ids = [(None, long), (None, long), (-5, long + " x"), (4, "y " + long), (4, long), (4, long), (2**62, "z z " + long)]
    assert rows(substring.remove_repeats(make_docs(ids))) == brute(ids)


def test_kept_text_is_returned(make_docs):
    head = " ".join(f"h{i}" for i in range(25))
    out = {r.doc_id: r.kept for r in substring.remove_repeats(make_docs([(1, head + " one"), (2, "two " + head + " three")])).collect()}
    assert out == {1: None, 2: "two three"}
