import hashlib
import re

from pathweave.llm import decontaminate, queries
from pathweave.llm.tables import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(queries.op10_decontamination(spark, sf_dir)) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_odd_rows_short_items_and_several_passes(spark, edge_docs, monkeypatch):
    items = [(1, "Word"), (2, "c A b c"), (3, "two THREE four five six seven eight nine ten eleven"), (4, None), (5, ""), (None, "word"), (6, "ü"),
             (10, "same text " * 9), (10, "same text " * 9), (11, "line one two three four five six line one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()], [i for i in items if None not in i])
    assert rows(decontaminate.contamination(documents(edge_docs), bench)) == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 10)
    assert rows(decontaminate.contamination(documents(edge_docs), bench)) == want


def test_nothing_to_search(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[5] for r in rows(decontaminate.contamination(documents(edge_docs), bench)))
    assert rows(decontaminate.contamination(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == []


def test_other_columns_pass_through(spark, edge_docs):
    out = decontaminate.with_passages(edge_docs, spark.createDataFrame([(1, "word")], "item_id long, text string"))
    assert set(out.columns) == set(edge_docs.columns) and out.count() == edge_docs.count()
