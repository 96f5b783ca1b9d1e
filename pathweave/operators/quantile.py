"""Exact quantiles of groups without a size bound, by radix selection.

The built-in ``percentile`` keeps every distinct value of a group in one task. For groups that may hold a
large share of the data the value is found by rank instead. A histogram over monotone buckets (combined before
its shuffle) tells which bucket holds the wanted rank; a bucket is 2^-10 wide in relative terms. Buckets of one
value are done. As long as another wanted bucket holds more than ``limit`` rows, its rows alone are kept and cut
into PIECES equal pieces between its least and largest value, again by a histogram, which narrows to single values
in at most four rounds. Wanted buckets of at most ``limit`` rows are ordered. The list of wanted buckets is
written out in each round: its true size then decides whether it is broadcast or joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.session import materialize

#: Rows that one ordering window may hold, and pieces that a crowded bucket is cut into.
LIMIT, PIECES = 1 << 16, 1 << 12


def _bucket(v: Column) -> Column:
    """Non-decreasing in v, about 0.07 % wide, symmetric around zero."""
    scaled = F.when(F.abs(v) == float("inf"), F.lit(4_000_000)).otherwise(F.floor(F.log2(F.abs(v)) * 1024) + 2_000_000).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, scaled).otherwise(-scaled)


def _piece(v: Column, lo: Column, hi: Column) -> Column:
    """Which of PIECES equal parts of [lo, hi] holds v; lo is in the first and hi in the last one."""
    return F.least(F.floor((v - lo) / (hi - lo) * PIECES), F.lit(PIECES - 1)).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], disc: bool = False, limit: int = LIMIT
) -> DataFrame:
    """One row per key with one column per entry of ``probs``.

    ``disc=False`` interpolates linearly between the neighbours of rank p*(n-1); ``disc=True`` takes the
    smallest value whose cumulative share reaches p (for p = 0.5: the lower median). NULL and NaN are skipped.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v")).filter(v.isNotNull() & ~F.isnan(v))
    if not keys:
        rows, keys = rows.withColumn("__all", F.lit(0)), ["__all"]
    rows = rows.withColumns({"__t": F.lit(0.0), "__b": _bucket(F.col("__v"))})
    hist = _histogram(rows, keys)
    hist = hist.withColumn("__n", F.sum("__c").over(W.partitionBy(*keys))).withColumn("__w", _wanted(probs, disc, F.col("__n")))
    hits = _hits(hist, keys)
    done = [_single(hits, keys)]
    crowded = F.col("__lo") < F.col("__hi")
    while (hits.filter(crowded).agg(F.max("__c")).first()[0] or 0) > limit:
        part = hits.filter(crowded).select(*keys, "__t", "__b", "__lo", "__hi")
        # the least value of a wanted bucket names it among those of its key
        rows = materialize(rows.join(part, [*keys, "__t", "__b"]).select(
            *keys, "__v", F.col("__lo").alias("__t"), _piece(F.col("__v"), F.col("__lo"), F.col("__hi")).alias("__b")), "quantile-rows")
        above = hits.filter(crowded).select(*keys, F.col("__lo").alias("__t"), F.col("__before").alias("__base"), "__w")
        hist = _histogram(rows, keys).join(above, [*keys, "__t"]).withColumn("__before", F.col("__before") + F.col("__base"))
        hits = _hits(hist, keys)
        done.append(_single(hits, keys))
    picked = reduce(DataFrame.unionByName, [*done, _ordered(rows, hits.filter(crowded), keys)])
    aggs = []
    for name in probs:
        part = F.when(F.col("__s.q") == name, F.struct(F.col("__s.rank").alias("r"), F.col("__v").alias("v"),
                                                         F.col("__s.w").alias("w")))
        lo, hi = F.min(part), F.max(part)
        # ranks agree: both values are the same, the weight does not matter
        between = F.when(lo["v"] == hi["v"], lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * hi["w"])
        aggs.append((lo["v"] if disc else between).alias(name))
    out = picked.groupBy(*keys).agg(*aggs)
    return out.drop("__all") if keys == ["__all"] else out


def exact_mad(df: DataFrame, keys: Sequence[str], value: str, disc: bool = False, limit: int = LIMIT,
              also: dict[str, float] | None = None) -> DataFrame:
    """Median and median absolute deviation from it, per key: ``med``, ``mad``, and the quantiles of ``also``; two selections, no group is gathered."""
    keys = list(keys)
    med = materialize(exact_quantiles(df, keys, value, {"med": 0.5, **(also or {})}, disc, limit), "medians")
    away = df.join(med.select(*keys, "med"), keys).select(*keys, F.abs(F.col(value).cast("double") - F.col("med")).alias("__away"))
    return med.join(exact_quantiles(away, keys, "__away", {"mad": 0.5}, disc, limit), keys)


def spread(df: DataFrame, keys: Sequence[str], value: str, kind: str, limit: int = LIMIT) -> DataFrame:
    """What ``upper_limit`` of this kind reads, per key, over the finite values: n, mu, sd, top, med, mad, q25, q75.

    A key whose values are all null or not finite keeps a row with n = 0.
    """
    keys, v = list(keys), F.col(value).cast("double")
    rows = df.select(*keys, F.when(F.abs(v) < float("inf"), v).alias("__x"))
    plain = rows.groupBy(*keys).agg(F.count("__x").alias("n"), F.avg("__x").alias("mu"), F.stddev_pop("__x").alias("sd"), F.max("__x").alias("top"))
    ranges = {"q25": 0.25, "q75": 0.75} if kind == "iqr" else {}
    middle = exact_mad(rows.filter("__x is not null"), keys, "__x", kind == "mean", limit, ranges)
    return plain.join(middle, keys, "left")


def upper_limit(factor: float, kind: str, margin: float = 1e-6) -> Column:
    """Upper threshold from the columns of ``spread``; the kinds are those of ``functions.arrays.robust_upper``."""
    med, mad, f = F.col("med"), F.col("mad"), F.lit(factor)
    wide = med + F.lit(factor * 1.4826) * mad
    if kind == "mean":
        out = F.when(mad > 1e-12, wide).otherwise(F.col("mu") + f * (F.col("sd") + F.lit(1e-12)))
    elif kind == "iqr":
        width = F.col("q75") - F.col("q25")
        out = F.when(mad > 1e-8, wide).when(width > 1e-8, F.col("q75") + f * width).otherwise(F.col("top"))
    elif kind == "margin":
        sigma = F.lit(1.4826) * mad
        out = F.when(sigma < margin, med + F.lit(margin)).otherwise(med + f * sigma)
    elif kind == "floor":
        out = med + f * F.greatest(F.lit(1.4826) * mad, F.lit(1e-8))
    else:
        raise ValueError(kind)
    return F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(out)


def robust_limits(df: DataFrame, keys: Sequence[str], value: str, factor: float, kind: str, margin: float = 1e-6, limit: int = LIMIT) -> DataFrame:
    """One row per key with the upper threshold ``limit`` of its values; ``df`` is read several times, so it should be a written table."""
    return spread(df, keys, value, kind, limit).select(*keys, upper_limit(factor, kind, margin).alias("limit"))


def _wanted(probs: dict[str, float], disc: bool, n: Column) -> Column:
    """The ranks to be found in a group of n rows, with the weight of each in its quantile."""
    wanted = []
    for name, p in probs.items():
        if disc:
            at = F.greatest(F.ceil(F.lit(p) * n).cast("bigint") - 1, F.lit(0))
            wanted.append(F.struct(F.lit(name).alias("q"), at.alias("rank"), F.lit(1.0).alias("w")))
            continue
        pos = F.lit(float(p)) * (n - 1)
        frac = pos - F.floor(pos)
        wanted.append(F.struct(F.lit(name).alias("q"), F.floor(pos).cast("bigint").alias("rank"), (1 - frac).alias("w")))
        wanted.append(F.struct(F.lit(name).alias("q"), F.ceil(pos).cast("bigint").alias("rank"), frac.alias("w")))
    return F.array(*wanted)


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, least and largest value per bucket, and how many rows of the same target lie before it."""
    hist = rows.groupBy(*keys, "__t", "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    upto = W.partitionBy(*keys, "__t").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    return hist.withColumn("__before", F.coalesce(F.sum("__c").over(upto), F.lit(0)))


def _inside(before: Column, count: Column) -> Column:
    return F.filter(F.col("__w"), lambda s: (s["rank"] >= before) & (s["rank"] < before + count))


def _hits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets that hold a wanted rank, with these ranks."""
    hits = hist.withColumn("__w", _inside(F.col("__before"), F.col("__c"))).filter(F.size("__w") > 0)
    return materialize(hits.select(*keys, "__t", "__b", "__c", "__lo", "__hi", "__before", "__w"), "quantile-buckets")


def _single(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.filter(F.col("__lo") == F.col("__hi")).select(*keys, F.col("__lo").alias("__v"), F.explode("__w").alias("__s"))


def _ordered(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks of buckets that are small enough to be ordered; equal values collapse before they are shuffled."""
    at = [*keys, "__t", "__b"]
    counts = rows.join(hits.select(*at), at, "left_semi").groupBy(*at, "__v").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*at).orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    found = counts.join(hits.select(*at, "__before", "__w"), at)
    found = found.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return found.select(*keys, "__v", F.explode(_inside(F.col("__before"), F.col("__n"))).alias("__s"))
