"""Hard negatives: for each anchor and each of its nearest rows of the same label, the rows of other labels whose score lies in a window.

A window runs from ``least`` to ``most`` hundredths of the positive's score. Slots: the upper limits of an anchor's windows, in
descending order, cut the scores into disjoint slots. A window is a run of slots from its own downwards, cut by its lower limit, so
its first k rows are among the first k of each of its slots. Tasks keep the first k per anchor and slot, these are combined by key,
and one pass over the slots of an anchor, from the lowest up, gives the first k of every window: a suffix of slots is the suffix
below merged with one slot more.

All anchors meet all rows, in blocks: a bounded block of anchors is sent to every task, which multiplies it with its rows batch by batch; the
next block follows. The first k of a slot among some of the rows bound what the rest can add, so after a first pass over every
``part``-th row, the pass over all rows passes on only what reaches that bound: what is shuffled follows the number of anchors, not that of tasks.

Scores are exact: integer products in the narrowest floating type that holds all of them, beyond that in Python's integers (a score
outside 64 bits is given as the nearest 64-bit value).

Defined results: rows without vec_id, label, vector or with a null or non-finite component take no part; a shorter vector counts as
padded with zeros; rows that repeat a vec_id are one row, that of the least (label, vector); an anchor without positives, or a window that
no row lies in (every window of a negative score), gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.tables import small_batches, written

#: Bytes of anchors that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: The first pass over slots reads every PART-th row.
PART = 16
SCALE = 256


def swapped(vec_id: Column, label: Column) -> Column:
    """The contract's change of labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def prepared(rows: DataFrame, label: Callable[[Column, Column], Column] = swapped, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles) of the rows that take part, one row per vec_id."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec_id, own = F.col("vec_id").cast("long"), F.col("label").cast("long")
    out = rows.filter(vec_id.isNotNull() & own.isNotNull() & F.col("embedding").isNotNull() & whole).select(
        # doubles from 2^52 on are whole
        vec_id.alias("vec_id"), label(vec_id, own).alias("label"), F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))
    out = written(out, "vectors")
    repeated = written(out.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return written(out.join(repeated, "vec_id", "left_anti").unionByName(once), "vectors")


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(sizes, default=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1)
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(len(a), d) @ np.array([[int(x) for x in row] for row in b], object).reshape(len(b), d).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64) if d else np.zeros((len(a), len(b)), np.int64)


def firsts(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, keys))
    ordered = keys[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class Best:
    """The first k entries per key of one task (keys are small integers), with the last score of full keys as a bound."""

    def __init__(self, keys: int, k: int, bound: np.ndarray | None = None):
        self.k, self.bound = k, np.full(keys, np.iinfo(np.int64).min) if bound is None else bound.copy()
        self.kept = (np.zeros(0, np.int64),) * 3
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((keys, scores, ids))
        self.n += len(keys)
        if self.n > max(1 << 20, len(self.kept[0])):
            self.combine()

    def combine(self) -> tuple[np.ndarray, ...]:
        keys, scores, ids = (np.concatenate(x) for x in zip(self.kept, *self.held))
        at = firsts(keys, scores, ids, self.k)
        self.kept, self.held, self.n = (keys[at], scores[at], ids[at]), [], 0
        full = np.flatnonzero(np.bincount(self.kept[0], minlength=len(self.bound)) == self.k)
        last = np.searchsorted(self.kept[0], full, "right") - 1
        self.bound[full] = np.maximum(self.bound[full], self.kept[1][last])
        return self.kept


CANDIDATES = "anchor_id long, slot int, score long, vec_id long"


def met(rows: DataFrame, anchors: list, same: bool, slots: int, k: int, purpose: str) -> DataFrame:
    """The first k rows of each task per anchor and slot, of those that reach the slot's bound: CANDIDATES, as a written table.

    ``anchors``: one block of tuples (vec_id, label, v, limits, floor, bounds): descending upper limits of its slots, the least score that
    matters and the bound per slot; ``same`` takes rows of the anchor's label (all of them are slot 0), else those of others.
    """
    width = max(len(a[2]) for a in anchors)
    sent = rows.sparkSession.sparkContext.broadcast((
        np.array([a[0] for a in anchors], np.int64), np.array([a[1] for a in anchors], np.int64),
        np.array([[*a[2], *[0.0] * (width - len(a[2]))] for a in anchors]).reshape(len(anchors), width),
        np.array([a[3] for a in anchors], np.int64).reshape(len(anchors), -1), np.array([a[4] for a in anchors], np.int64),
        np.array([a[5] for a in anchors], np.int64).reshape(-1)))

    def run(batches):
        own, labels, vectors, limits, floor, bounds = sent.value
        by_label = {c: np.flatnonzero(labels == c) for c in np.unique(labels).tolist()}
        best = Best(len(own) * slots, k, bounds)
        for batch in batches:
            ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            m = matrix(batch.column(2))
            parts = [(by_label[c], np.flatnonzero(label == c)) for c in np.unique(label).tolist() if c in by_label] if same else [(np.arange(len(own)), np.arange(len(ids)))]
            for who, whom in parts:
                # a few thousand scores per anchor at a time: the batch is at most 1,000 rows
                for i in range(0, len(who), 2048):
                    at = who[i : i + 2048]
                    score = products(vectors[at], m[whom])
                    if same:
                        fits = (own[at][:, None] != ids[whom]) & (score >= best.bound[at][:, None])
                        a, r = np.nonzero(fits)
                        best.add(at[a], score[a, r], ids[whom[r]])
                    else:
                        fits = (labels[at][:, None] != label[whom]) & (score >= floor[at][:, None]) & (score <= limits[at, :1])
                        a, r = np.nonzero(fits)
                        got = score[a, r]
                        slot = (limits[at][a] >= got[:, None]).sum(1) - 1
                        key = at[a] * slots + slot
                        reach = got >= best.bound[key]
                        best.add(key[reach], got[reach], ids[whom[r[reach]]])
        keys, scores, vec = best.combine()
        yield pa.RecordBatch.from_arrays([pa.array(own[keys // slots]), pa.array((keys % slots).astype(np.int32)), pa.array(scores), pa.array(vec)],
                                         ["anchor_id", "slot", "score", "vec_id"])

    small_batches(rows.sparkSession)
    out = written(rows.select("vec_id", "label", "v").mapInArrow(run, CANDIDATES), purpose)
    sent.unpersist()
    return out


def in_passes(rows: DataFrame, anchors: DataFrame, size: int, same: bool, slots: int, k: int, purpose: str) -> DataFrame:
    """``met`` for all anchors (vec_id, label, v, limits, floor, bounds), block after block, combined to the first k. A block holds half of
    ``size`` on average, dealt by hash, so that even the largest one stays near ``size``."""
    out = None
    spread = anchors.withColumn("__block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-anchors.count() // max(1, size // 2))))))
    spread = written(spread.repartition("__block"), f"{purpose}-anchors")
    for b in sorted(r[0] for r in spread.select("__block").distinct().collect()):
        block = spread.filter(F.col("__block") == b).select("vec_id", "label", "v", "limits", "floor", "bounds").collect()
        part = met(rows, block, same, slots, k, purpose)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], CANDIDATES + ", rank int")
    w = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return written(out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), purpose)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, least: int = 30, most: int = 90, label=swapped, scale: int = SCALE,
         block_bytes: int = BLOCK_BYTES, part: int = PART) -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    vectors = prepared(rows, label, scale)
    none = np.iinfo(np.int64).min
    anchors = vectors.filter(is_anchor)
    size = max(2, block_bytes // (8 * (anchors.agg(F.max(F.size("v"))).first()[0] or 1) + 100 * positives))
    blank = {"limits": F.array(F.lit(0).cast("long")), "floor": F.lit(none), "bounds": F.array(F.lit(none))}
    near = in_passes(vectors, anchors.withColumns(blank), size, True, 1, positives, "positives")
    near = near.filter("score >= 0").withColumnRenamed("vec_id", "positive_id")
    exact = F.col("score").cast("decimal(20,0)")
    near = near.withColumns({"low": F.ceil(exact * least / 100).cast("long"), "high": F.floor(exact * most / 100).cast("long")})
    near = written(near.filter("low <= high").select("anchor_id", "positive_id", "score", "rank", "low", "high"), "windows")
    slots = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list("high"), asc=False).alias("limits"), F.min("low").alias("floor"))
    pad = F.array_repeat(F.lit(none), positives - F.size("limits"))
    slots = anchors.join(slots.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("limits", F.concat("limits", pad))
    every = slots.withColumn("bounds", F.array_repeat(F.lit(none), positives))
    some = in_passes(vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0), every, size, False, positives, k, "first")
    reached = some.filter(F.col("rank") == k).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("m"))
    bounded = slots.join(reached, "vec_id", "left").withColumn("bounds", F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda s: F.coalesce(F.col("m")[s], F.lit(none)))).drop("m")
    found = in_passes(vectors, bounded, size, False, positives, k, "negatives")
    return merged(near, found, k)


def merged(windows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The first k of each window from the first k of each slot: at most positives * k candidates an anchor, in descending order."""
    best = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("c"))
    # descending order of all slots is the merge of every suffix at once; a window is the run of it between its limits
    own = F.slice(F.filter("c", lambda e: (-e["s"] >= F.col("low")) & (-e["s"] <= F.col("high"))), 1, k)
    return windows.join(best, "anchor_id").select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode(own)).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("negative_id"), "positive_score",
        (-F.col("col.s")).alias("negative_score"))


def sql() -> str:
    """The contract's parameters in plain SQL."""
    return """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
 n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank
   from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10"""
