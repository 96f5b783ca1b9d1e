"""Exact nearest neighbours in many dimensions, where a grid has too many cells around a point.

A few pivots give every point its distances to them. Points of a group are ordered by nearest pivot and distance to it, numbered, and
cut into tiles of a bounded size, however large the group. By the triangle inequality the ranges of two tiles' distances to a
pivot bound the distance of any two of their points from below. A first round gives each tile its neighbours within the tile and so
an upper bound of its k-th distances (the ranges of another tile with k points bound them too); tile pairs whose lower bound exceeds
it are skipped, all others meet as two matrices in a task. The best lists of a point are merged by key. No group is packed into one
row and no way is chosen by size. The points that ask and the points that are found may be different sets.

Matrix products only choose the rows that may be nearest; their distances are then taken from the coordinates themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.session import materialize

TILE = 1024
PIVOTS = 8
#: Slack of the bounds for rounding in the distances to pivots.
SLACK = 1e-9


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def tiled(points: DataFrame, keys: Sequence[str], ident: str, vec: str, tile: int, pivots: int, carry: Sequence[str] = ()) -> DataFrame:
    """points with ``tile`` (number within the group) and ``far``, the distances to the pivots: the rows of lowest hash."""
    seeds = [list(r[0]) for r in points.orderBy(F.xxhash64(ident, F.lit("pivot")), ident).limit(pivots).select(F.col(vec).cast("array<double>")).collect()]
    far = F.array(*[distance(F.col(vec), F.array(*map(F.lit, s))) for s in seeds]) if seeds else F.array().cast("array<double>")
    rows = points.withColumn("far", far)
    rows = rows.withColumns({"near": F.array_min("far"), "pivot": F.array_position("far", F.array_min("far"))})
    by = [*keys, "pivot", "near", ident]
    ranged = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "tiles")
    counts = ranged.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(counts.withColumn("__before", before), ["__part", *keys])
    pos = F.col("__before") + F.col("__row") - F.col("__first")
    return ranged.withColumn("tile", F.floor(pos / F.lit(tile)).cast("long")).select(*keys, ident, vec, *carry, "far", "tile")


def nearest_of(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of a, id, squared distance) of the first k rows of b per row of a within ``limit``, nearest first, ties by id."""
    if not len(a) or not len(b):
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    sq_a, sq_b = (a * a).sum(1), (b * b).sum(1)
    d2 = sq_a[:, None] + sq_b - 2.0 * (a @ b.T)
    slack = 8 * (a.shape[1] + 2) * np.finfo(float).eps * (sq_a + sq_b.max())  # of the expanded squares
    d2[ids_a[:, None] == ids_b] = np.inf
    cut = limit
    if k < d2.shape[1]:
        cut = np.minimum(cut, np.partition(d2, k - 1, axis=1)[:, k - 1])
    row, col = np.nonzero((d2 <= (cut + 2 * slack)[:, None]) & np.isfinite(d2))
    exact = ((a[row] - b[col]) ** 2).sum(1)
    row, col, exact = (x[exact <= limit[row]] for x in (row, col, exact))
    order = np.lexsort((ids_b[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    first = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) < k
    return row[first], ids_b[col[first]], exact[first]


def nearest(points: DataFrame, keys: Sequence[str], ident: str, vec: str, k: int, tile: int = TILE, pivots: int = PIVOTS,
            ask: str | None = None, give: str | None = None) -> DataFrame:
    """Per point: keys, ident and ``nn``, up to k other points of its group as (d2, ident), nearest first, ties by ident.

    ``keys`` may not be empty; ``vec`` is an array<double> of one length without nulls; ``ident`` a long, unique in its group.
    With the boolean columns ``ask`` and ``give`` only points that ask get a row, and only points that give are found.
    Points that find nobody have no row.
    """
    keys = list(keys)
    flag = {"ask": F.col(ask) if ask else F.lit(True), "give": F.col(give) if give else F.lit(True)}
    points = points.select(*keys, F.col(ident).cast("long").alias(ident), F.struct(
        F.col(vec).cast("array<double>").alias("v"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flag.items()]).alias("point"))
    points = points.filter(F.col("point.ask") | F.col("point.give")).select("*", F.col("point.v").alias(vec))
    rows = materialize(tiled(points, keys, ident, vec, tile, pivots, ["point"]), "tiled")
    low, high = (F.array(*[f(F.get("far", F.lit(p))) for p in range(pivots)]) for f in (F.min, F.max))
    packed = rows.groupBy(*keys, "tile").agg(
        F.collect_list(F.struct(F.col(ident).alias("id"), "point.*")).alias("rows"), low.alias("low"), high.alias("high"),
        F.count_if("point.ask").alias("n_ask"), F.count_if("point.give").alias("n_give"))
    packed = materialize(packed.select(*keys, "tile", "low", "high", "n_ask", "n_give", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("v"),
                                       F.col("rows.ask").alias("ask"), F.col("rows.give").alias("give")), "packed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, asks, other_ids, other_v, gives, limits = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (
                    "ids", "v", "ask", "other_ids", "other_v", "give", "limits"))
                limits = limits if len(limits) else np.full(len(ids), np.inf)
                own = ids[asks]
                row, nb, d2 = nearest_of(v.reshape(len(ids), -1)[asks], other_v.reshape(len(other_ids), -1)[gives], own, other_ids[gives], k, limits[asks])
                fixed = [batch.column(c).take(pa.array(np.full(len(row), i))) for c in [*keys, "tile"]]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(own[row]), pa.array(nb), pa.array(d2)], [*keys, "tile", "id", "nb", "d2"])

    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys), "tile bigint, id bigint, nb bigint, d2 double"])
    order = W.partitionBy(*keys, "id").orderBy("d2", "nb")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.array().cast("array<double>")
    alone = packed.filter("n_ask > 0 and n_give > 0").select(
        *keys, "tile", "ids", "v", "ask", F.col("ids").alias("other_ids"), F.col("v").alias("other_v"), "give", none.alias("limits"))
    first = materialize(alone.repartition(*keys, "tile").mapInArrow(meet, schema), "within")
    # the k-th distance of each point so far, in the order of the tile's ids; a tile's bound is the largest of them
    kth = first.groupBy(*keys, "tile", "id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d")).filter(F.col("n") == k)
    kth = kth.groupBy(*keys, "tile").agg(F.map_from_entries(F.collect_list(F.struct("id", "d"))).alias("m"), F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    limits = F.transform("ids", lambda i: F.coalesce(F.col("m")[i], F.lit(float("inf"))))
    own = packed.join(kth, [*keys, "tile"], "left").select(
        *packed.columns, F.coalesce(limits, F.array_repeat(F.lit(float("inf")), F.size("ids"))).alias("limits"),
        F.when(F.col("n") == F.col("n_ask"), F.sqrt("d")).otherwise(float("inf")).alias("bound"))
    own = materialize(own, "bounds")
    met = meeting_tiles(own, keys, k).join(own.select(*keys, F.col("tile").alias("other"), F.col("ids").alias("other_ids"), F.col("v").alias("other_v"), "give"), [*keys, "other"])
    met = met.join(own.select(*keys, "tile", "ids", "v", "ask", "limits"), [*keys, "tile"]).select(*alone.columns)
    found = best(first.unionByName(met.repartition(*keys, "tile", F.xxhash64("other_ids")).mapInArrow(meet, schema)))
    return found.groupBy(*keys, F.col("id").alias(ident)).agg(F.sort_array(F.collect_list(F.struct("d2", F.col("nb").alias(ident)))).alias("nn"))


def meeting_tiles(tiles: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Pairs (tile, other) of a group that may hold a k-th neighbour. Tiles, not points, are paired; the pairs fetch their points afterwards."""
    a = tiles.filter("n_ask > 0").select(*keys, "tile", "low", "high", "bound")
    b = tiles.filter("n_give > 0").select(*keys, F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), "n_give")
    zipped = F.arrays_zip("low", "high", "low2", "high2")
    gap = F.array_max(F.transform(zipped, lambda z: F.greatest(z["low"] - z["high2"], z["low2"] - z["high"], F.lit(0.0))))
    reach = F.array_min(F.transform(zipped, lambda z: z["high"] + z["high2"]))  # no two of their points are farther apart
    pairs = a.join(b, list(keys)).filter(F.col("tile") != F.col("other")).withColumns({"gap": gap, "reach": F.when(F.col("n_give") >= k, reach)})
    bound = F.least("bound", F.min("reach").over(W.partitionBy(*keys, "tile")))
    return pairs.withColumn("bound", bound).filter(F.col("gap") <= F.col("bound") * (1 + SLACK) + SLACK).select(*keys, "tile", "other")
