import hashlib
import re

import pytest

from pathweave.llm import pii, queries
from pathweave.llm.tables import documents


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    """The contract, by Python's own expressions."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def expected(rows):
    out = []
    for doc, text in rows:
        s = base_spans(text)
        line = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in s)
        out.append((doc, *(sum(k == i for _, k, _ in s) for i in range(4)), hashlib.sha256(line.encode()).hexdigest(), line))
    return sorted(out, key=str)


def got(df):
    out = []
    for r in df.collect():
        spans = [s for s in r.spans.split(",") if s]
        names = pii.BASE + pii.ADDED
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), names.index(s.split(":")[0])))
        assert sum(s.split(":")[0] in pii.ADDED for s in spans) == r.n_added
        out.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(s for s in spans if s.split(":")[0] in pii.BASE)))
    return sorted(out, key=str)


def test_query_base_spans(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = queries.op11_pii(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got(out) == expected(docs) and any(r[1] for r in expected(docs))


ODD = ["a@b.c_d@e.f.", "a@b@c.d e@f", ".@-.-@x..y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 999999999999999999999.1.1.1", "4111 1111-1111 1111 4111  1111", "41111111111111115", "0" * 14 + " 5 6",
       "+1 (555) 123-4567 (x +12 345 +123456789012345678 +1--------", "é🤖 a.b@mail.example.com 🤖+49 30 1234567890é 10.0.0.1", "+1 555 123 4567 +1 555 123 4567", "a@b.c" * 40, "12 " * 3000, "x" * 200_000,
       "1." * 50_000, "a@b.c\n" * 5000, "+" * 1000 + "1" * 12]


def test_odd_texts(spark, edge_docs, no_docs, make_docs):
    docs = make_docs([*enumerate(ODD), (3, ODD[3]), (None, "a@b.c"), (90, None), (91, "")])
    assert got(pii.report(docs, pii.NOTHING)) == expected(docs.collect())
    edge = documents(edge_docs)
    assert got(pii.report(edge)) == expected(edge.collect())
    assert pii.report(no_docs).collect() == []


def learnable(n=600):
    out = []
    for i in range(n):
        digits = f"4{i * 7919 % 10**12:014d}"
        check = next(c for c in "0123456789" if luhn(digits + c))
        wrong = str((int(check) + 5) % 10)
        out.append(f"call +1 ({i % 900 + 100}) 555-{i % 9000 + 1000} card {digits}{check} order {digits}{wrong} end")
    return out


def test_trees_add_what_base_patterns_miss(spark, make_docs):
    model = pii.fit(make_docs(enumerate(learnable())))
    assert model.thresholds["number"] <= 1 and model.thresholds["call"] <= 1
    short = next(f"422222222222{c}" for c in "0123456789" if luhn(f"422222222222{c}"))
    wrong = f"422222222222{(int(short[-1]) + 5) % 10}"
    rows = {1: f"card {short} x", 2: f"order {wrong} x", 3: "call (212) 555-1234 now", 4: "call +1 (212) 555-1234 now"}
    spans = {r.doc_id: r.spans for r in pii.report(make_docs(rows.items()), model).collect()}
    assert spans == {1: "number:5:18", 2: "", 3: "call:5:19", 4: "phone:5:22"}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_scan_by_chunks(spark, n):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i * 37 % 11).cast("long")).alias("v")).select(F.slice("v", 1, n).alias("v"))
    row = row.select("v", pii.scan(F.col("v"), 0, pii.add).alias("s"), pii.scan(F.col("v"), -1, pii.larger).alias("m")).first()
    assert list(row.s) == [sum(row.v[:i]) for i in range(n)] and list(row.m) == [max([-1, *row.v[:i]]) for i in range(n)]


def test_learning_takes_every_proposal(spark, monkeypatch):
    """30,000 proposals, of which the size alone tells the right ones."""
    seen, size = {}, len(pii.FEATURES)
    monkeypatch.setattr(pii, "written", lambda df, purpose, write=pii.written: seen.setdefault(purpose, write(df, purpose)))
    more = f"array(struct(6 as k, array_repeat(cast(id % 4 as double), {size}) as f, id % 4 >= 2 as inside, id % 4 < 2 as failed)) as more"
    model = pii.learn(spark.range(30_000).selectExpr("cast(id % 5 as int) as fold", more))
    rows = seen["pii-candidates"]
    assert rows.count() == 20 and rows.agg({"n": "sum"}).first()[0] == 30_000
    assert 0.5 < model.thresholds["number"] <= 1 and model.thresholds["mail"] > 1
