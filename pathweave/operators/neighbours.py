"""Nearest neighbours and distance graphs inside groups (a frame's points, a demo's first frame).

Two exact ways, chosen by the measured size of each group:

* groups of at most ``frame_limit`` points become one row of packed coordinates; Spark spreads those rows and
  a small numpy kernel works on one frame's distance matrix inside the task. No pair leaves the task.
* larger groups are searched on a grid. Equal positions keep only the k+1 lowest ids (a query can never need
  more of them), the first cell edge is so fine that no cell is crowded, and queries whose k-th neighbour is
  not yet certain go on to the doubled edge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.operators.sequence import first_n
from pathweave.session import materialize

FRAME_LIMIT = 4096
CROWDED = 64
MATRIX_CELLS = 2_000_000  # distances held at once by one task
LEVELS = 40


def _packed(df: DataFrame, keys: Sequence[str], ident: str, cols: Sequence[str]) -> DataFrame:
    p = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ident, *cols))).alias("p"))
    return p.select(*keys, F.col(f"p.{ident}").alias("ids"), *[F.col(f"p.{c}").cast("array<double>").alias(c) for c in cols])


def _split_by_size(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups within the limit, rows of larger groups); oversized groups are few: total / limit, and mostly there are none (None)."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    big = materialize(big, "large-groups")
    if big.isEmpty():
        return df, None
    return df.join(big, list(keys), "left_anti"), df.join(big, list(keys), "left_semi")


def knn(df: DataFrame, keys: Sequence[str], ident: str, cols: Sequence[str], k: int, frame_limit: int = FRAME_LIMIT,
        known_small: bool = False) -> DataFrame:
    """Per point: ``nn``, up to k neighbours of the same group as (d2, id), nearest first, ties by id.

    ``known_small`` skips the size check where the grouping itself bounds the groups (points of one frame of a
    tracker with a fixed query grid).
    """
    small, large = (df, None) if known_small else _split_by_size(df, keys, frame_limit)
    out = _knn_packed(small, keys, ident, cols, k)
    if large is None or large.isEmpty():
        return out
    return out.unionByName(_knn_grid(large, keys, ident, cols, k))


def _nn_type(df: DataFrame, ident: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField(ident, df.schema[ident].dataType)]))


def _knn_packed(df: DataFrame, keys: Sequence[str], ident: str, cols: Sequence[str], k: int) -> DataFrame:
    packed = _packed(df, keys, ident, cols)
    keys, cols = list(keys), list(cols)

    nn_arrow = pa.list_(pa.struct([("d2", pa.float64()), (ident, pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = b.column("ids").offsets.to_numpy()
            ids = b.column("ids").values.to_numpy(zero_copy_only=False)
            axes = [(b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy(zero_copy_only=False)) for c in cols]
            counts = np.diff(offsets)
            for n in np.unique(counts):
                rows = np.flatnonzero(counts == n)
                for part in np.array_split(rows, max(1, int(len(rows) * n * n / MATRIX_CELLS))):
                    if len(part):
                        yield frames_of_size(b, int(n), part, offsets, ids, axes)

    def frames_of_size(b, n, part, offsets, ids, axes):
        """Neighbours of all frames with n points at once, as (frames, n, k) arrays."""
        within = np.arange(n)
        own = ids[offsets[part][:, None] + within]
        d2 = np.zeros((len(part), n, n))
        for off, values in axes:
            p = values[off[part][:, None] + within]
            d2 += (p[:, :, None] - p[:, None, :]) ** 2
        d2[:, within, within] = np.inf
        kk = min(k, n - 1)
        order = np.argsort(d2, axis=2, kind="stable")[:, :, :kk]  # ids ascend, so ties go to the lower id
        near = np.take_along_axis(d2, order, axis=2).reshape(-1)
        names = own[np.arange(len(part))[:, None, None], order].reshape(-1)
        struct = pa.StructArray.from_arrays([pa.array(near), pa.array(names.astype("int64"))], ["d2", ident])
        nn = pa.ListArray.from_arrays(pa.array(np.arange(len(part) * n + 1, dtype="int32") * kk), struct)
        take = pa.array(np.repeat(part, n))
        columns = [b.column(c).take(take) for c in keys] + [pa.array(own.reshape(-1)), nn.cast(nn_arrow)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, ident, "nn"])

    schema = T.StructType([packed.schema[c] for c in keys]
                          + [T.StructField(ident, df.schema[ident].dataType), T.StructField("nn", _nn_type(df, ident))])
    return packed.mapInArrow(kernel, schema)


def _knn_grid(df: DataFrame, keys: Sequence[str], ident: str, cols: Sequence[str], k: int) -> DataFrame:
    keys, cols = list(keys), list(cols)
    pts = df.select(*keys, ident, *[F.col(c).cast("double").alias(c) for c in cols])
    distinct = first_n(pts, keys + cols, [F.col(ident)], k + 1, salt_by=[ident]).drop("rank")
    box = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.greatest(*[
        F.max(c) - F.min(c) for c in cols]).alias("__ext"), *[F.min(c).alias(f"__o_{c}") for c in cols])
    box = box.withColumn("__ext", F.greatest(F.col("__ext"), F.lit(1e-9)))

    def cell(edge):
        return [F.floor((F.col(c) - F.col(f"__o_{c}")) / edge).cast("bigint").alias(f"__g_{c}") for c in cols]

    gcols = [f"__g_{c}" for c in cols]
    # coarsest level whose fullest cell is not crowded; counted on distinct positions
    spots = distinct.select(*keys, *cols).distinct().join(box, keys)
    by_level = spots.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    by_level = by_level.select(*keys, "__l", *cell(F.col("__ext") / F.pow(F.lit(2.0), F.col("__l"))))
    fill = by_level.groupBy(*keys, "__l", *gcols).count().groupBy(*keys, "__l").agg(F.max("count").alias("m"))
    start = fill.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("m") <= CROWDED, F.col("__l"))), F.lit(LEVELS)).alias("__l"))
    box = materialize(box.join(start, keys), "knn-box")

    todo = materialize(pts, "knn-todo")
    cand0 = materialize(distinct, "knn-points")
    done = None
    for step in range(LEVELS + 2):
        edge = F.col("__ext") / F.pow(F.lit(2.0), F.col("__l") - step)
        q = todo.join(box, keys).withColumn("__e", edge)
        q = q.select("*", *cell(F.col("__e")))
        around = F.lit(None)
        offsets = [F.struct(*[F.lit(o).alias(g) for o, g in zip(t, gcols)]) for t in np.ndindex(*[3] * len(cols))]
        around = q.select(*keys, ident, "__e", "__n", *cols, *gcols, F.explode(F.array(*offsets)).alias("o")).select(
            *keys, ident, "__e", "__n", *cols, *[(F.col(g) + F.col(f"o.{g}") - 1).alias(g) for g in gcols])
        c = cand0.join(box, keys).select(*keys, F.col(ident).alias("__cid"), *[F.col(x).alias(f"__c_{x}") for x in cols], *cell(edge))
        pairs = around.join(c, keys + gcols).filter(F.col(ident) != F.col("__cid"))
        d2 = sum(((F.col(x) - F.col(f"__c_{x}")) ** 2 for x in cols[1:]), (F.col(cols[0]) - F.col(f"__c_{cols[0]}")) ** 2)
        pairs = pairs.withColumn("d2", d2)
        w = W.partitionBy(*keys, ident).orderBy("d2", "__cid")
        best = pairs.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
        found = best.groupBy(*keys, ident).agg(
            F.sort_array(F.collect_list(F.struct("d2", F.col("__cid").alias(ident)))).alias("nn"),
            F.max("d2").alias("__worst"), F.max("__e").alias("__e"), F.max("__n").alias("__n"))
        # everything closer than one edge lies in the searched cells; at edge >= extent all cells were searched
        sure = ((F.size("nn") >= F.least(F.lit(k), F.col("__n") - 1)) & (F.col("__worst") <= F.col("__e") ** 2)) | (
            F.lit(step) >= F.col("__l"))
        found = materialize(found.join(box.select(*keys, "__l"), keys).filter(sure).select(*keys, ident, "nn"), "knn-found")
        done = found if done is None else done.unionByName(found)
        todo = materialize(todo.join(found.select(*keys, ident), keys + [ident], "left_anti"), "knn-todo")
        if todo.isEmpty():
            break
    return done.withColumn("nn", F.col("nn").cast(_nn_type(df, ident)))


def knn_mean(nn) -> F.Column:
    """Mean distance to the listed neighbours; null for a point that has none."""
    d = F.transform(nn, lambda s: F.sqrt(s["d2"]))
    return F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(nn), F.lit(0))


def largest_component(df: DataFrame, keys: Sequence[str], ident: str, cols: Sequence[str], threshold: str,
                      frame_limit: int = FRAME_LIMIT, known_small: bool = False) -> DataFrame:
    """Adds ``component`` (lowest id of the connected component) and ``in_largest`` per point. Points of a group
    are linked when their distance is at most the group's ``threshold`` column; of equally large components
    the one with the lowest id wins."""
    small, large = (df, None) if known_small else _split_by_size(df, keys, frame_limit)
    out = _components_packed(small, keys, ident, cols, threshold)
    if large is None or large.isEmpty():
        return out
    labelled = _components_grid(large, keys, ident, cols, threshold)
    size = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("__best"))
    return out.unionByName(labelled.join(best, list(keys)).withColumn("in_largest", F.col("component") == F.col("__best")).drop("__best"))


def _components_packed(df, keys, ident, cols, threshold):
    p = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ident, *cols))).alias("p"), F.max(threshold).alias("thr"))
    packed = p.select(*keys, "thr", F.col(f"p.{ident}").alias("ids"),
                      *[F.col(f"p.{c}").cast("array<double>").alias(c) for c in cols])
    keys, cols = list(keys), list(cols)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in equal_sizes(b["ids"].map(len).to_numpy()):
                p = b.iloc[part]
                linked = np.sqrt(squared_distances([np.stack(p[c]) for c in cols])) <= p["thr"].to_numpy(float)[:, None, None]
                label = components(linked)
                named = np.take_along_axis(np.stack(p["ids"]), label, axis=1)
                yield p[keys + ["ids"]].assign(component=list(named), in_largest=list(in_largest(label)))

    id_type = df.schema[ident].dataType
    schema = T.StructType([packed.schema[c] for c in keys + ["ids"]] + [
        T.StructField("component", T.ArrayType(id_type)), T.StructField("in_largest", T.ArrayType(T.BooleanType()))])
    out = packed.mapInPandas(kernel, schema).select(*keys, F.inline(F.arrays_zip("ids", "component", "in_largest")))
    return out.withColumnRenamed("ids", ident)


def equal_sizes(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of groups of one size, so many at once that their distances fit MATRIX_CELLS."""
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        for part in np.array_split(rows, max(1, -(-len(rows) * int(n) ** 2 // MATRIX_CELLS))):
            if len(part):
                yield part


def squared_distances(axes: Sequence[np.ndarray]) -> np.ndarray:
    """(groups, n, n) from one (groups, n) array per axis."""
    d2 = np.zeros((*axes[0].shape, axes[0].shape[1]))
    for x in axes:
        d2 += (x[:, :, None] - x[:, None, :]) ** 2
    return d2


def components(linked: np.ndarray) -> np.ndarray:
    """(groups, n): the first point of each point's component, for many groups of n points at once. Changes the diagonals of ``linked``."""
    f, n = linked.shape[:2]
    linked[:, np.arange(n), np.arange(n)] = True
    label = np.broadcast_to(np.arange(n), (f, n))
    while True:
        new = np.where(linked, label[:, None, :], n).min(axis=2)
        new = np.take_along_axis(new, new, axis=1)  # jump to the label of the label
        if np.array_equal(new, label):
            return label
        label = new


def in_largest(label: np.ndarray) -> np.ndarray:
    """(groups, n): whether a point lies in its group's largest component, of equal ones the first."""
    f, n = label.shape
    counts = np.bincount((label + n * np.arange(f)[:, None]).ravel(), minlength=f * n).reshape(f, n)
    return label == counts.argmax(axis=1)[:, None]


def component_labels(pts: np.ndarray, threshold: float) -> np.ndarray:
    """Index of the first point of each point's component."""
    return components(np.sqrt(squared_distances([pts[:, a][None] for a in range(pts.shape[1])])) <= threshold)[0]


def _components_grid(df, keys, ident, cols, threshold):
    """Groups too large for one matrix: cells of edge threshold/sqrt(dim) are connected inside by construction, so
    cells are the nodes; only neighbouring cells compare points, and labels spread by minimum with jumping."""
    keys, cols = list(keys), list(cols)
    gcols = [f"__g_{c}" for c in cols]
    edge = F.col(threshold) / F.lit(float(np.sqrt(len(cols)))) * F.lit(1 - 1e-12)
    pts = df.withColumns({g: F.floor(F.col(c).cast("double") / edge).cast("bigint") for g, c in zip(gcols, cols)})
    pts = materialize(pts.select(*keys, ident, threshold, *[F.col(c).cast("double").alias(c) for c in cols], *gcols), "comp-points")
    cells = pts.groupBy(*keys, *gcols).agg(F.min(ident).alias("node"))
    spots = pts.groupBy(*keys, threshold, *cols, *gcols).agg(F.lit(1)).join(cells, keys + gcols)
    reach = int(np.ceil(np.sqrt(len(cols)))) + 1
    offsets = [t for t in np.ndindex(*[2 * reach + 1] * len(cols)) if t > tuple([reach] * len(cols))]
    out = spots.select("*", F.explode(F.array(*[F.struct(*[F.lit(o - reach).alias(g) for o, g in zip(t, gcols)])
                                               for t in offsets])).alias("o"))
    out = out.select(*keys, threshold, "node", *cols, *[(F.col(g) + F.col(f"o.{g}")).alias(g) for g in gcols])
    other = spots.select(*keys, *gcols, F.col("node").alias("other"), *[F.col(c).alias(f"__c_{c}") for c in cols])
    d2 = sum(((F.col(c) - F.col(f"__c_{c}")) ** 2 for c in cols[1:]), (F.col(cols[0]) - F.col(f"__c_{cols[0]}")) ** 2)
    links = out.join(other, keys + gcols).filter(F.sqrt(d2) <= F.col(threshold)).select(*keys, "node", "other").distinct()
    links = materialize(links.unionByName(links.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))), "comp-links")
    label = materialize(cells.select(*keys, "node", F.col("node").alias("label")), "comp-label")
    while True:
        near = links.join(label.select(*keys, F.col("node").alias("other"), F.col("label").alias("l2")), keys + ["other"])
        low = near.groupBy(*keys, "node").agg(F.min("l2").alias("l2"))
        new = label.join(low, keys + ["node"], "left").select(*keys, "node", "label", F.least("label", "l2").alias("new"))
        jump = new.select(*keys, F.col("node").alias("new"), F.col("new").alias("j"))
        new = new.join(jump, keys + ["new"], "left").select(*keys, "node", "label", F.least("new", "j").alias("new"))
        new = materialize(new, "comp-label")
        changed = not new.filter(F.col("new") != F.col("label")).isEmpty()
        label = new.select(*keys, "node", F.col("new").alias("label"))
        if not changed:
            break
    of_cell = cells.join(label, keys + ["node"]).select(*keys, *gcols, F.col("label").alias("component"))
    return pts.join(of_cell, keys + gcols).select(*keys, ident, "component")
