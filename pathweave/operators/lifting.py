"""From 2D tracks and depth images to 3D points. Points meet their frame's image by (demo, t); the image stays one
array per frame and single pixels are read by position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.arrays import let, quantile, quantile_sorted
from pathweave.functions.geometry import bilinear
from pathweave.functions.numeric import clip
from pathweave.operators.compose import BLOCK, follow
from pathweave.operators.sequence import meet, sparse_neighbour

FRAME = ["demo_id", "t"]


def on_frame(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Equi join on the frame. The key is (demo, t), so a long demo is spread over the tasks frame by frame."""
    return meet(points, frames, FRAME)


def patch_depth(points: DataFrame, images: DataFrame | None, side: int, radius: int, mode: str, percentile: float = 0.2) -> DataFrame:
    """Adds pz, px, py, pd to points with pixel columns u, v: depth and place of the window's pixel whose depth is
    nearest to the window's target, plus 1e-4 per pixel of distance (pd); first in row order on ties.

    Targets: patch_min, patch_median, patch_percentile. Without a valid pixel: the bilinear value at the place.
    Without ``images`` the points carry their frame's image already (z, h, w). The window is written out as scalar columns, which compile into plain arithmetic on the image array.
    """
    u, v, img = F.col("u"), F.col("v"), F.col("z")
    n, width = (2 * radius + 1) ** 2, 2 * radius + 1
    cx, cy = F.rint(clip(u, 0.0, side - 1.0)).cast("int"), F.rint(clip(v, 0.0, side - 1.0)).cast("int")
    j = (points if images is None else on_frame(points, images)).withColumns({"__cx": cx, "__cy": cy})
    places = [(F.col("__cx") + (i % width - radius), F.col("__cy") + (i // width - radius)) for i in range(n)]

    def read(x: Column, y: Column) -> Column:
        z = F.get(img, y * side + x)
        return F.when((x >= 0) & (x < side) & (y >= 0) & (y < side) & (z > 0) & (z < float("inf")) & ~F.isnan(z), z)

    j = j.withColumns({f"__z{i}": read(x, y) for i, (x, y) in enumerate(places)})
    zs = [F.col(f"__z{i}") for i in range(n)]
    if mode == "patch_min":
        target = F.least(*zs)
    else:
        q = 0.5 if mode == "patch_median" else percentile
        j = j.withColumn("__zs", F.sort_array(F.array_compact(F.array(*zs))))
        target = quantile_sorted(F.col("__zs"), q)
    j = j.withColumn("__t", target)
    dist = [F.sqrt((x - u) * (x - u) + (y - v) * (y - v)) for x, y in places]
    j = j.withColumns({f"__s{i}": F.abs(zs[i] - F.col("__t")) + 1e-4 * dist[i] for i in range(n)})
    j = j.withColumn("__m", F.least(*[F.col(f"__s{i}") for i in range(n)]))
    best = F.lit(None).cast("int")
    for i in reversed(range(n)):
        best = F.when(F.col(f"__s{i}") == F.col("__m"), i).otherwise(best)
    j = j.withColumn("__i", best)
    px, py = (F.col("__cx") + F.col("__i") % width - radius, F.col("__cy") + F.floor(F.col("__i") / width) - radius)
    j = j.withColumns({"pz": F.coalesce(F.get(F.array(*zs), F.col("__i")), bilinear(img, side, side, u, v)),
                       "px": F.coalesce(px.cast("double"), u), "py": F.coalesce(py.cast("double"), v)})
    own = [c for c in j.columns if c.startswith("__")]
    return j.withColumn("pd", F.sqrt((F.col("px") - u) * (F.col("px") - u) + (F.col("py") - v) * (F.col("py") - v))).drop("z", "h", "w", *own)


def choose_nearest(prev: np.ndarray | None, xyz: np.ndarray, zs: np.ndarray, pd_: np.ndarray, weight: float, percentile: float) -> int:
    """Candidate nearest to the point chosen before; without a finite one, nearest to the window's depth percentile."""
    if prev is None or not np.isfinite(prev).all():
        return int(np.argmin(np.abs(zs - np.percentile(zs, percentile * 100)) + 1e-4 * pd_))
    return int(np.argmin(np.sqrt(((xyz - prev) ** 2).sum(axis=1)) + weight * pd_))


def first_least(scores: Column) -> Column:
    """Position of the least score, the first of equals."""
    return let(scores, lambda s: F.array_position(s, F.array_min(s)).cast("int") - 1)


def temporal_patch(cands: DataFrame, weight: float, percentile: float, block: int = BLOCK) -> DataFrame:
    """Choice that depends on the point chosen in the frame before (``cands``: demo_id, point_id, t and the arrays
    cx, cy, cz, z, pd of candidate positions).

    A frame maps the candidates of the frame before to its own, so tracks are composed block by block (operators.compose) and no
    task walks a whole track. A window without candidates (a hole in the depth) takes the position bx, by, bz where these
    columns exist, else its position is null; after a null or non-finite position the choice begins anew.
    """
    key = ["demo_id", "point_id"]
    cands = cands.withColumns({b: F.lit(None).cast("double") for b in ("bx", "by", "bz") if b not in cands.columns})
    own = F.transform("cx", lambda x, i: F.struct(x.alias("x"), F.get("cy", i).alias("y"), F.get("cz", i).alias("z")))
    hole = F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z")))
    rows = cands.select(*key, "t", "z", "pd", F.when(F.size("cx") > 0, own).otherwise(hole).alias("spots"), (F.size("cx") > 0).alias("seen"))
    rows = sparse_neighbour(rows, key, "t", "last", value="spots", previous=True)

    def known(p: Column) -> Column:
        return F.coalesce(p["x"] - p["x"] == 0, F.lit(False)) & F.coalesce(p["y"] - p["y"] == 0, F.lit(False)) & F.coalesce(p["z"] - p["z"] == 0, F.lit(False))

    anew = let(quantile(F.col("z"), percentile), lambda q: first_least(F.zip_with("z", "pd", lambda z, d: F.abs(z - q) + 1e-4 * d)))

    def nearest(p: Column) -> Column:
        def apart(s):
            return F.sqrt((s["x"] - p["x"]) * (s["x"] - p["x"]) + (s["y"] - p["y"]) * (s["y"] - p["y"]) + (s["z"] - p["z"]) * (s["z"] - p["z"]))

        return first_least(F.zip_with("spots", "pd", lambda s, d: apart(s) + weight * d))

    before = F.coalesce("last", F.array(F.struct(*[F.lit(None).cast("double").alias(c) for c in "xyz"])))
    pick = F.transform(before, lambda p: F.when(~F.col("seen"), F.lit(0)).when(known(p), nearest(p)).otherwise(anew))
    out = follow(rows.withColumn("m", pick), key, "t", "m", carry=["spots"], block=block)
    spot = F.get("spots", F.col("after"))
    return out.select(*key, "t", *[spot[c].alias(c) for c in "xyz"])
