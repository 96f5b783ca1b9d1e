import glob
import json

import pytest
from pyspark.sql import functions as F

from pathweave.functions import text as tx
from pathweave.functions.arrays import channels_last
from pathweave.session import scratch_dir
from pathweave.sources.catalog import FOOTERS, column_bounds, column_counts, footers, inspect_tables
from pathweave.sources.tables import match_raw, nested_lines, write_nested


def test_catalog_of_several_files_nulls_and_nested_columns(spark):
    path, empty = scratch_dir(spark, "t-cat"), scratch_dir(spark, "t-empty")
    rows = [(i, None if i % 3 else i * 10, "x" if i % 2 else None, [i, None] if i % 4 else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, n int, s string, l array<int>, none int").repartition(3)
    df.withMetadata("n", {"unit": "mm"}).write.parquet(path)
    df.limit(0).write.mode("append").parquet(path)
    df.limit(0).write.parquet(empty)
    before = {k: spark.conf.get(k) for k in FOOTERS}
    got = {(r.tbl, r.column): (r.dtype, r.n_rows, r.n_values, r.lo, r.hi, r.attributes) for r in inspect_tables(spark, {"a": path, "e": empty}).collect()}
    assert before == {k: spark.conf.get(k) for k in FOOTERS}
    assert {c: v for (t, c), v in got.items() if t == "a"} == {
        "id": ("bigint", 40, 40, 0, 39, None), "n": ("int", 40, 14, 0, 390, '{"unit": "mm"}'), "s": ("string", 40, 20, None, None, None),
        "l": ("array<int>", 40, None, None, None, None), "none": ("int", 40, 0, None, None, None)}
    assert {c: v[1:5] for (t, c), v in got.items() if t == "e"} == {c: (0, None if c == "l" else 0, None, None) for c in df.columns}
    with pytest.raises(ValueError):
        inspect_tables(spark, {})


def test_catalog_reads_footers_only(spark, sf_dir):
    with footers(spark):
        t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        shown = [df._jdf.queryExecution().executedPlan().toString() for df in (column_counts("t", t), column_bounds("t", t, ["l_orderkey"]))]
    assert "PushedAggregation: [COUNT(*)" in shown[0] and "PushedAggregation: [MIN(l_orderkey), MAX(l_orderkey)]" in shown[1]


def test_raw_trajectories(spark):
    raws = spark.createDataFrame([("one", 70), ("many", 5), ("many", 6), ("many", 9)], "file string, raw_id bigint")
    demos = spark.createDataFrame([("one", 1, "demo_8"), ("one", 2, "x"), ("many", 3, "demo_2"), ("many", 4, "last"), ("many", 5, "demo_3"),
                                   ("many", 6, "a_" + "9" * 30), ("many", 7, None), ("none", 8, "demo_0")], "file string, demo bigint, name string")
    got = {(r.demo, r.raw_id) for r in match_raw(demos, raws).collect()}
    # demo 4 is second in its file; 5 and 6 are out of range, and so is 7, the fifth; 8 has no raw trajectory
    assert got == {(1, 70), (2, 70), (3, 9), (4, 6)}
    assert match_raw(demos, raws.filter("false")).count() == 0


def test_nested_manifest_is_one_text_per_task(spark):
    rows = [(f"task \"{t}\"", d, s, 7, json.dumps({"seg": [s, s + 7]})) for t in range(3) for d in range(t, t + 3) for s in range(0, 7 * (d % 3 + 1), 7)]
    rows += [("alone", 5, 3, 2, "{}")]
    df = spark.createDataFrame(rows, "task string, demo_id bigint, s0 int, n_frames int, entry string").repartition(4)
    path = scratch_dir(spark, "t-manifest")
    write_nested(df, path)
    text, docs = "".join(open(p).read().replace("\n", "") for p in sorted(glob.glob(f"{path}/part-*"))), []
    while text:
        doc, end = json.JSONDecoder().raw_decode(text)
        docs.append(doc)
        text = text[end:]
    assert [d["task"] for d in docs] == ["alone", 'task "0"', 'task "1"', 'task "2"']
    for doc in docs:
        own = [r for r in rows if r[0] == doc["task"]]
        assert (doc["n_demos"], doc["n_segments"], doc["n_frames"]) == (len({r[1] for r in own}), len(own), sum(r[3] for r in own))
        assert [(x["demo_id"], len(x["segments"]), x["segments"]) for x in doc["demos"]] == [
            (d, len(e), e) for d in sorted({r[1] for r in own}) for e in [[json.loads(r[4]) for r in sorted(own) if r[1] == d]]]
    assert nested_lines(df.filter("false")).count() == 0


def test_picture_layouts(spark):
    cases = [([1, 2, 3, 4, 5, 6], [1, 2, 3]), ([1, 2, 3, 4, 5, 6], [3, 2, 1]), ([1, 2], [2, 1, 1]), (list(range(12)), [3, 2, 2]),
             (list(range(8)), [1, 2, 2, 2]), ([], [0, 2]), (None, [2, 2]), ([1, 2], None)]
    df = spark.createDataFrame(cases, "v array<int>, s array<int>")
    got = [r[0] for r in df.select(channels_last(F.col("v"), F.col("s"))).collect()]
    # one row or column leaves two dimensions, which are grey
    assert got[0] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 6] and got[1] == got[0]
    assert got[2] is None and got[3] == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11]
    assert got[4:] == [None, [], None, None]


def test_prompts(spark):
    df = spark.createDataFrame([(" p ", "a/b c d"), (" ", "a/b  c d"), (None, ""), (None, None), (None, " / ")], "found string, task string")

    def got(*args):
        return [r[0] for r in df.select(tx.resolve_prompt(F.col("found"), args[0], F.col("task"), *args[1:])).collect()]

    assert got(None, 3) == ["p", "a b c", "object", "object", ""]
    assert got(" fixed ", 3, "go") == ["go. p"] + ["go. fixed"] * 4
    assert got(None, None, "go.") == ["go. p"] + ["go. object"] * 4
