"""Ordered operators whose work units stay bounded however long one sequence is.

A plain window over (demo) puts a whole episode into one task. Here the time axis is cut into blocks of
``size`` frames:

* neighbours (lead, lag, sliding frames): every block gets copies of the few rows it needs from the blocks
  beside it (its halo), so a window over (key, block) gives the same answer as one over (key);
* prefixes (running sum, running maximum, last seen value): block-local window plus the carry of the
  blocks before, which is a window over one row per block;
* row numbers over an arbitrary order column: counts per coarse and fine bucket, added up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
BLK = "__blk"
HALO = "__halo"


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join of sides whose rows are exploded or carry arrays made by expressions.

    Spark estimates such sides without the fan-out and the array's length, and would broadcast what does not fit the driver. The hint
    makes both sides meet by a shuffle, whose tasks stay bounded and whose skewed keys AQE splits.
    """
    return left.hint("merge").join(right, list(keys), how)


def with_halo(df: DataFrame, t: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Assign each row to its block and copy it into the neighbouring blocks whose halo it belongs to."""
    if max(before, after) > size:
        raise ValueError("halo larger than a block")
    pos = F.pmod(F.col(t), F.lit(size))
    own = F.floor(F.col(t) / F.lit(size)).cast("bigint")
    owners = [own]
    if before:
        owners.append(F.when(pos >= size - before, own + 1))
    if after:
        owners.append(F.when(pos < after, own - 1))
    out = df.withColumn(BLK, F.explode(F.array_compact(F.array(*owners))))
    return out.withColumn(HALO, F.col(BLK) != own)


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    make: Callable[[W], dict[str, Column]],
    before: int = 1,
    after: int = 1,
    size: int = BLOCK,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` frames away. ``make`` gets the ordered window.

    Rows that carry their block already (frames that were copied before their points were written out) are taken as they are."""
    w = W.partitionBy(*keys, BLK).orderBy(t)
    haloed = df if BLK in df.columns else with_halo(df, t, before, after, size)
    return haloed.withColumns(make(w)).filter(~F.col(HALO)).drop(BLK, HALO)


_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    specs: dict[str, tuple[str, str]],
    exclusive: bool = False,
    reverse: bool = False,
    size: int = BLOCK,
) -> DataFrame:
    """Running aggregates along ``t``: ``specs`` maps the new column to (kind, column), kind one of
    sum, max, min, last (last non-null value seen). ``reverse`` runs from the end of the sequence."""
    order = F.col(t).desc() if reverse else F.col(t).asc()
    blk_order = F.col(BLK).desc() if reverse else F.col(BLK).asc()
    local = W.partitionBy(*keys, BLK).orderBy(order)
    local = local.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    outer = W.partitionBy(*keys).orderBy(blk_order).rowsBetween(W.unboundedPreceding, -1)

    blocked = df.withColumn(BLK, F.floor(F.col(t) / F.lit(size)).cast("bigint"))
    totals, carries, locals_, outs = [], {}, {}, {}
    for out, (kind, name) in specs.items():
        c = F.col(name)
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            totals.append(pick(c, F.when(c.isNotNull(), F.col(t))).alias(f"__c_{out}"))
            carries[f"__c_{out}"] = F.last(F.col(f"__c_{out}"), ignorenulls=True).over(outer)
            locals_[out] = F.last(c, ignorenulls=True).over(local)
            outs[out] = F.coalesce(F.col(out), F.col(f"__c_{out}"))
            continue
        fn = _KINDS[kind]
        totals.append(fn(c).alias(f"__c_{out}"))
        carries[f"__c_{out}"] = fn(F.col(f"__c_{out}")).over(outer)
        locals_[out] = fn(c).over(local)
        a, b = F.col(out), F.col(f"__c_{out}")
        if kind == "sum":
            outs[out] = F.when(a.isNull() & b.isNull(), None).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            )
        else:
            outs[out] = F.greatest(a, b) if kind == "max" else F.least(a, b)
    carry = blocked.groupBy(*keys, BLK).agg(*totals).withColumns(carries)
    rows = blocked.withColumns(locals_)
    return rows.join(carry, [*keys, BLK], "left").withColumns(outs).drop(BLK, *carries)


def sparse_neighbour(
    df: DataFrame, keys: Sequence[str], t: str, out: str, value: str | None = None, previous: bool = False,
    size: int = BLOCK,
) -> DataFrame:
    """``value`` (default ``t``) of the next (or previous) existing row; frames need not be dense."""
    return prefix(df, keys, t, {out: ("last", value or t)}, exclusive=True, reverse=not previous, size=size)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: Sequence[Column], out: str = "t"
) -> DataFrame:
    """Zero-based row number per key in the order of ``order``.

    ``levels`` are coarse-to-fine buckets, each monotone in the order columns (for example day, second).
    Every window sees the buckets of one parent bucket only, so a key that holds a third of all rows is
    spread over as many tasks as it has fine buckets.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    df = df.withColumns(dict(zip(names, levels)))
    counts = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    # offset of a bucket = rows of earlier siblings, plus the offset of its parent
    offsets = None
    for depth in range(len(names)):
        parent, own = names[:depth], names[: depth + 1]
        level = counts.groupBy(*keys, *own).agg(F.sum("__n").alias("__n")) if depth + 1 < len(names) else counts
        w = W.partitionBy(*keys, *parent).orderBy(names[depth]).rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumn("__o", F.coalesce(F.sum("__n").over(w), F.lit(0)))
        if offsets is not None:
            level = (
                meet(level, offsets.withColumnRenamed("__o", "__po"), [*keys, *parent])
                .withColumn("__o", F.col("__o") + F.col("__po"))
                .drop("__po")
            )
        offsets = level.select(*keys, *own, "__o")
    w = W.partitionBy(*keys, *names).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(w) - 1)
    # offsets may have as many rows as the input, which Spark estimates by the size of its compressed files
    return (
        meet(ranked, offsets, [*keys, *names])
        .withColumn(out, (F.col("__o") + F.col("__r")).cast("int"))
        .drop("__r", "__o", *names)
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, salts: int = 64,
            salt_by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first n rows per key: n per (key, salt) first, then n of those, so no task sees a whole hot key."""
    limit = n if isinstance(n, Column) else F.lit(n)
    if salt_by:
        salted = df.withColumn("__s", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
        w0 = W.partitionBy(*keys, "__s").orderBy(*order)
        df = salted.withColumn("__r", F.row_number().over(w0)).filter(F.col("__r") <= limit).drop("__r", "__s")
    w1 = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w1)).filter(F.col(rank) <= limit)
