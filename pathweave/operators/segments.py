"""Segmentation of a binary state signal and frame selection inside segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.numeric import nan_to_zero
from pathweave.operators.sequence import BLOCK, over_neighbours, prefix, sparse_neighbour

DEMO = ("demo_id",)


def binarize(df: DataFrame, signal: str, plus_is_close: bool = True, rule: str = "midpoint", rescale: bool = False,
             keys: Sequence[str] = DEMO, out: str = "state") -> DataFrame:
    """0/1 state of a signal: strict comparison with the middle of its range per key, or with zero."""
    g = nan_to_zero(signal)
    g = (g - 0.5) * 2.0 if rescale else g
    if rule == "zero":
        return df.withColumn(out, F.when(g > 0 if plus_is_close else g < 0, 1).otherwise(0))
    if rule != "midpoint":
        raise ValueError(rule)
    mid = df.groupBy(*keys).agg((0.5 * (F.min(g) + F.max(g))).alias("__mid"))
    hit = g > F.col("__mid") if plus_is_close else g < F.col("__mid")
    return df.join(mid, list(keys)).withColumn(out, F.when(hit, 1).otherwise(0)).drop("__mid")


def debounced_changes(df: DataFrame, state: str, debounce: int, keys: Sequence[str] = DEMO, t: str = "t",
                      size: int = BLOCK) -> DataFrame:
    """Frames where a new state starts and stays for ``debounce`` frames (or to the end). The first frame of
    every key is in the result as well, so each key has at least one row.

    A change is a candidate when the frames t .. t+debounce-1 that exist all agree; that needs a bounded look
    ahead. Of the candidates those count whose state differs from the candidate before them.
    """
    d = max(1, int(debounce))

    def make(w):
        ahead = w.rowsBetween(0, d - 1)
        return {"__p": F.lag(state).over(w), "__lo": F.min(state).over(ahead), "__hi": F.max(state).over(ahead)}

    marked = over_neighbours(df.select(*keys, t, state), keys, t, make, before=1, after=d - 1, size=size)
    heads = marked.filter((F.col(t) == 0) | ((F.col(state) != F.col("__p")) & (F.col("__lo") == F.col("__hi"))))
    heads = heads.select(*keys, t, state)
    seen = sparse_neighbour(heads, keys, t, "__before", value=state, previous=True, size=size)
    return seen.filter(F.col("__before").isNull() | (F.col("__before") != F.col(state))).select(*keys, t, state)


def segments(df: DataFrame, state: str, debounce: int, min_len: int, lengths: DataFrame, variant: str = "stage",
             keep_last: bool = True, keys: Sequence[str] = DEMO, t: str = "t", size: int = BLOCK) -> DataFrame:
    """Segments [s0, s1) per key. ``lengths`` has one row per key with the track length ``t_len``.

    What happens when too little is left depends on the consumer:

    stage:     whole demo if no segment survived and t_len >= min_len
    viewer:    whole demo if there was no change and t_len >= min_len, else nothing
    training:  whole demo if there was no change, whatever its length
    inference: no minimum; the last segment is extended to t_len when the signal is shorter than the track
    """
    return choose_segments(boundaries(df, state, debounce, lengths, keys, t, size), lengths, min_len, variant, keep_last, keys)


def boundaries(df: DataFrame, state: str, debounce: int, lengths: DataFrame, keys: Sequence[str] = DEMO, t: str = "t",
               size: int = BLOCK) -> DataFrame:
    """All stretches [s0, s1) between debounced changes, with is_last."""
    keys = list(keys)
    signal = df.join(lengths.select(*keys, "t_len"), keys).filter(F.col(t) < F.col("t_len"))
    b = debounced_changes(signal, state, debounce, keys, t, size).withColumnRenamed(t, "s0").drop(state)
    b = sparse_neighbour(b, keys, "s0", "__next", size=size).join(lengths.select(*keys, "t_len"), keys)
    return b.select(*keys, "s0", F.coalesce("__next", "t_len").cast("int").alias("s1"), F.col("__next").isNull().alias("is_last"))


def choose_segments(b: DataFrame, lengths: DataFrame, min_len: int, variant: str, keep_last: bool = True,
                    keys: Sequence[str] = DEMO) -> DataFrame:
    """The stretches a consumer uses; see ``segments`` for the variants."""
    if variant not in ("stage", "viewer", "training", "inference"):
        raise ValueError(variant)
    keys = list(keys)
    only = F.col("is_last") & (F.col("s0") == 0)  # no change at all in this demo
    keep = F.lit(True) if keep_last else ~F.col("is_last") | only
    long_enough = F.col("s1") - F.col("s0") >= min_len
    rule = {"inference": keep, "training": only | (keep & long_enough)}.get(variant, keep & long_enough)
    good = b.filter(rule).select(*keys, "s0", "s1")
    if variant in ("viewer", "training"):
        return good
    floor = min_len if variant == "stage" else 1
    whole = lengths.filter(F.col("t_len") >= floor).join(good.select(*keys).distinct(), keys, "left_anti")
    return good.unionByName(whole.select(*keys, F.lit(0).alias("s0"), F.col("t_len").cast("int").alias("s1")))


def join_interval(rows: DataFrame, intervals: DataFrame, keys: Sequence[str] = DEMO, t: str = "t", lo: str = "s0",
                  hi: str = "s1", how: str = "inner", bucket: int = 64) -> DataFrame:
    """Rows with lo <= t < hi. Intervals are copied to the time buckets they touch, which makes it an equi join
    on (key, bucket): no nested loop, and a long demo is spread over its buckets."""
    spread = intervals.withColumn("__tb", F.explode(F.sequence(
        F.floor(F.col(lo) / F.lit(bucket)).cast("int"), F.floor((F.col(hi) - 1) / F.lit(bucket)).cast("int"))))
    left = rows.withColumn("__tb", F.floor(F.col(t) / F.lit(bucket)).cast("int"))
    right = spread.withColumnsRenamed({k: f"__{k}" for k in keys} | {"__tb": "__rtb"})
    cond = (F.col("__tb") == F.col("__rtb")) & (F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, cond, how).drop("__tb", "__rtb", *[f"__{k}" for k in keys])


def segment_end_of(frames: DataFrame, segs: DataFrame, keys: Sequence[str] = DEMO, t: str = "t") -> DataFrame:
    """Inclusive end of the segment a frame lies in; frames before the first segment get its end, frames in a gap
    or after the last one get the end of the last segment."""
    hit = join_interval(frames, segs.select(*keys, "s0", "s1"), keys, t, how="left")
    edge = segs.groupBy(*keys).agg(
        F.min("s0").alias("__f0"), F.min_by("s1", "s0").alias("__f1"), F.max_by("s1", "s0").alias("__l1"))
    out = hit.join(edge, list(keys))
    end = F.when(F.col(t) < F.col("__f0"), F.col("__f1")).otherwise(F.coalesce(F.col("s1"), F.col("__l1"))) - 1
    return out.withColumn("seg_end", end.cast("int")).drop("s0", "s1", "__f0", "__f1", "__l1")


def resample_indices(start: Column, end: Column, num: int, gamma_s: float = 1.2, gamma_e: float = 1.6,
                     min_unique: float = 0.7) -> Column:
    """``num`` non-decreasing frame indices from start to end, denser at both ends (gamma 1 is uniform).

    The warp is a constant of (num, gammas) and is folded into a literal array; per row only num multiplications
    are left. Too few distinct indices fall back to uniform spacing; end <= start repeats the start.
    """
    us = [i / (num - 1) if num > 1 else 0.0 for i in range(num)]
    warp = [0.5 * (2.0 * u) ** gamma_s if u <= 0.5 else 1.0 - 0.5 * (2.0 * (1.0 - u)) ** gamma_e for u in us]
    span = (end - start).cast("double")

    def idx(ws: list[float]) -> Column:
        inner = F.transform(F.array(*[F.lit(w) for w in ws[1:-1]]), lambda w: F.rint(start + span * w).cast("int")) \
            if num > 2 else F.array().cast("array<int>")
        return F.concat(F.array(start.cast("int")), inner, F.array(end.cast("int")) if num > 1 else F.array().cast("array<int>"))

    # both weight lists ascend, so rounding keeps the order and the running maximum is already in place
    dense = idx(warp)
    few = F.size(F.array_distinct(dense)) < int(min_unique * num)
    return (
        F.when(end <= start, F.array_repeat(start.cast("int"), num))
        .when(few, idx(us))
        .otherwise(dense)
    )


def anchors(segs: DataFrame, stride: int, min_len: int, inclusive: bool = False) -> DataFrame:
    """Start frames s0, s0+stride, ... before the last frame of a segment (up to it when ``inclusive``)."""
    ok = segs.filter(F.col("s1") - F.col("s0") >= max(min_len, 1 if inclusive else 2))
    last = F.col("s1") - (1 if inclusive else 2)
    return ok.withColumn("s", F.explode(F.sequence(F.col("s0"), last, F.lit(stride))))


def carry_forward(df: DataFrame, value: str, out: str, keys: Sequence[str] = DEMO, t: str = "t", size: int = BLOCK) -> DataFrame:
    return prefix(df, keys, t, {out: ("last", value)}, size=size)
