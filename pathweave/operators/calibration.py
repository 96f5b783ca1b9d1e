"""Fits between coordinate systems. A fit needs only additive moments of its correspondences, so the data-sized part
is one grouped aggregate; the 3x3 decompositions run on one short row per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.functions.geometry import apply_sim3, at
from pathweave.functions.numeric import all_finite, hash_u32, norm, text
from pathweave.operators.quantile import exact_quantiles
from pathweave.operators.sampling import subsample, train_val_split
from pathweave.operators.sequence import meet
from pathweave.session import materialize

SRC, DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")
FIT = "scale double, rot array<double>, trans array<double>"


def pair(src: DataFrame, dst: DataFrame, keys: Sequence[str], src_cols: Sequence[str], dst_cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Correspondences: rows of both variants with the same key, as sx..sz, dx..dz, and the source's columns ``carry``."""
    a = src.select(*keys, *carry, *[F.col(c).alias(n) for c, n in zip(src_cols, SRC)])
    b = dst.select(*keys, *[F.col(c).alias(n) for c, n in zip(dst_cols, DST)])
    return meet(a, b, keys).withColumns({n: F.col(n).cast("double") for n in SRC + DST})  # whole numbers are shorter on the way


def moments(corr: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """n, sum x, sum y, sum |x|^2, sum y x^T and sum x x^T per group; partial sums before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    aggs = [F.sum(w).alias("n"), F.sum(w * sum((F.col(c) * F.col(c) for c in SRC[1:]), F.col(SRC[0]) * F.col(SRC[0]))).alias("xx")]
    aggs += [F.sum(w * F.col(c)).alias(f"m_{c}") for c in SRC + DST]
    aggs += [F.sum(w * F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a in DST for b in SRC]
    aggs += [F.sum(w * F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for i, a in enumerate(SRC) for b in SRC[i:]]
    return corr.groupBy(*keys).agg(*aggs)


def sim3_batch(n: np.ndarray, mx: np.ndarray, my: np.ndarray, xx: np.ndarray, yx: np.ndarray):
    """Similarities from moments for a whole batch: arrays (g,), (g,3), (g,3), (g,), (g,3,3). Invalid rows give NaN."""
    n1 = np.maximum(n, 1.0)
    mean_x, mean_y = mx / n1[:, None], my / n1[:, None]
    var = xx / n1 - (mean_x**2).sum(axis=1)
    cov = yx / n1[:, None, None] - mean_y[:, :, None] * mean_x[:, None, :]
    good = (n >= 3) & (var >= 1e-12) & np.isfinite(cov).all(axis=(1, 2))
    u, s, vt = np.linalg.svd(np.where(good[:, None, None], cov, np.eye(3)))
    sign = np.ones((len(n), 3))
    sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    rot = (u * sign[:, None, :]) @ vt
    scale = (s * sign).sum(axis=1) / np.where(good, var, 1.0)
    trans = mean_y - scale[:, None] * np.einsum("gij,gj->gi", rot, mean_x)
    scale = np.where(good, scale, np.nan)
    return scale, rot, trans


def fit_sim3(corr: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """scale, rot (row-major) and trans per group; NULL scale for fewer than 3 or degenerate correspondences."""
    m, keys = moments(corr, keys, weight), list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yx = b[[f"c_{a}_{c}" for a in DST for c in SRC]].to_numpy(float).reshape(-1, 3, 3)
            scale, rot, trans = sim3_batch(b["n"].to_numpy(float), b[[f"m_{c}" for c in SRC]].to_numpy(float),
                                           b[[f"m_{c}" for c in DST]].to_numpy(float), b["xx"].to_numpy(float), yx)
            yield b[keys + ["n"]].assign(scale=[None if np.isnan(v) else v for v in scale], rot=list(rot.reshape(-1, 9)), trans=list(trans))

    schema = T.StructType([m.schema[k] for k in keys + ["n"]] + list(T._parse_datatype_string(FIT).fields))
    return m.mapInPandas(solve, schema)


def fit_affine(corr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a (3x3, row-vector convention) and b per group, least squares by the pseudo-inverse of the normal matrix."""
    m, keys = moments(corr, keys), list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = len(b)
            normal, rhs = np.zeros((g, 4, 4)), np.zeros((g, 4, 3))
            for i, p in enumerate(SRC):
                for j, q in enumerate(SRC[i:], start=i):
                    normal[:, i, j] = normal[:, j, i] = b[f"g_{p}_{q}"]
                normal[:, i, 3] = normal[:, 3, i] = b[f"m_{p}"]
                for j, q in enumerate(DST):
                    rhs[:, i, j] = b[f"c_{q}_{p}"]
            normal[:, 3, 3] = b["n"]
            for j, q in enumerate(DST):
                rhs[:, 3, j] = b[f"m_{q}"]
            sol = np.linalg.pinv(normal) @ rhs
            yield b[keys + ["n"]].assign(a=list(sol[:, :3].reshape(g, 9)), b=list(sol[:, 3]))

    schema = T.StructType([m.schema[k] for k in keys + ["n"]] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in "ab"])
    return m.mapInPandas(solve, schema)


def moved(fit_cols: tuple[str, str, str] = ("scale", "rot", "trans"), cols: Sequence[str] = SRC) -> list[Column]:
    scale, rot, trans = (F.col(c) for c in fit_cols)
    return apply_sim3(scale, rot, [F.get(trans, F.lit(i)) for i in range(3)], [F.col(c) for c in cols])


def residual() -> Column:
    """Distance between the transformed source and the target; needs the fit's columns on the row."""
    return norm(*[m - F.col(c) for m, c in zip(moved(), DST)])


def with_residual(corr: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One fit row per group meets its correspondences; a small side by size, and AQE splits a hot group."""
    return corr.join(fit.select(*keys, "scale", "rot", "trans"), list(keys)).withColumn("err", residual())


def trimmed_fit(corr: DataFrame, keys: Sequence[str], percentile: float = 0.95, rounds: int = 2, min_points: int = 16) -> DataFrame:
    """Fit, drop residuals above the percentile of the survivors, fit again. A group stops at the round that would
    leave it fewer than ``min_points``. The rounds are written out; nothing is collected."""
    keys = list(keys)
    live, fit = corr, materialize(fit_sim3(corr, keys), "fit")
    frozen = None
    for _ in range(rounds):
        r = with_residual(live, fit, keys)
        cut = exact_quantiles(r, keys, "err", {"cut": percentile})
        kept = materialize(r.join(cut, keys).filter(F.col("err") <= F.col("cut")).drop("cut"), "kept")
        enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_points).select(*keys)
        stopped = fit.join(enough, keys, "left_anti")
        frozen = stopped if frozen is None else frozen.unionByName(stopped)
        live = kept.join(enough, keys, "left_semi").drop("scale", "rot", "trans", "err")
        fit = materialize(fit_sim3(live, keys), "fit")
    return fit if frozen is None else fit.unionByName(frozen)


def split_fits(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], parts: int, threshold: float) -> DataFrame:
    """Fits to disjoint hash classes ``h`` of a group's correspondences, each judged on all of them: n, n_inliers, median_err."""
    keys = list(keys)
    corr = materialize(corr, "corr")
    fits = fit_sim3(corr.withColumn("h", hash_class(keys, ids, parts)), [*keys, "h"]).filter("scale is not null")
    hyp = fits.groupBy(*keys).agg(F.collect_list(F.struct("h", "scale", "rot", "trans")).alias("hyps"))
    # the group's short list of fits rides on the correspondence; no pair rows
    scored = corr.join(hyp, keys).withColumn("e", F.transform("hyps", lambda s: norm(*[
        m - F.col(c) for m, c in zip(apply_sim3(s["scale"], s["rot"], [F.get(s["trans"], F.lit(i)) for i in range(3)], [F.col(x) for x in SRC]), DST)])))
    flat = scored.select(*keys, F.inline(F.arrays_zip(F.col("hyps.h").alias("h"), F.col("e").alias("err"))))
    counts = flat.groupBy(*keys, "h").agg(F.count_if(F.col("err") <= threshold).alias("n_inliers"), F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(flat, [*keys, "h"], "err", {"median_err": 0.5})
    return counts.join(med, [*keys, "h"]).select(*keys, "h", "n", "n_inliers", "median_err")


def hash_class(keys: Sequence[str], ids: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys, *ids), F.lit(parts))


#: Correspondences that are scored against all hypotheses of their group at once.
BLOCK = 2048


def draw_positions(pool: int, iterations: int, seed: int) -> np.ndarray:
    """Four different positions (all, of a smaller pool) below ``pool`` per hypothesis: a hashed start and a hashed step."""
    k = min(4, pool)
    h = np.arange(2 * iterations, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    start = (h[:iterations] % np.uint64(pool)).astype(np.int64)
    step = 1 + (h[iterations:] % np.uint64(max(1, (pool - 1) // max(1, k - 1)))).astype(np.int64)
    return (start[:, None] + step[:, None] * np.arange(k)) % pool


def hypotheses(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], iterations: int, seed: int = 0) -> DataFrame:
    """``iterations`` fits per group, each to four correspondences, as arrays (scale, rot and trans one after another).

    Draws come from the group's 4 x iterations rows of lowest hash, so a group's row stays short whatever its size.
    """
    keys = list(keys)
    pool = subsample(corr.withColumn("__o", hash_u32(*keys, *ids, text("order"), seed)), keys, ids, 4 * iterations, "ransac", seed)
    packed = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", *ids, *SRC, *DST))).alias("c"))
    packed = packed.filter(F.size("c") >= 3).select(*keys, *[F.col(f"c.{c}").alias(c) for c in SRC + DST])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cols in zip(*[b[c] for c in SRC + DST]):
                xyz = np.stack(cols, axis=1)
                at_ = draw_positions(len(xyz), iterations, seed)
                x, y = xyz[at_][:, :, :3], xyz[at_][:, :, 3:]
                cx, cy = x.mean(axis=1), y.mean(axis=1)  # centred, against cancellation
                x, y = x - cx[:, None], y - cy[:, None]
                zero = np.zeros((iterations, 3))
                scale, rot, _ = sim3_batch(np.full(iterations, float(x.shape[1])), zero, zero, (x**2).sum(axis=(1, 2)), np.einsum("hki,hkj->hij", y, x))
                out.append((scale, rot.ravel(), (cy - scale[:, None] * np.einsum("hij,hj->hi", rot, cx)).ravel()))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(out, columns=["hs", "hr", "ht"])], axis=1)

    schema = T.StructType([packed.schema[k] for k in keys] + list(T._parse_datatype_string("hs array<double>, hr array<double>, ht array<double>").fields))
    return packed.mapInPandas(kernel, schema)


def inliers(x: np.ndarray, y: np.ndarray, scale: np.ndarray, rot: np.ndarray, trans: np.ndarray, threshold: float) -> np.ndarray:
    """(hypotheses, rows): whether |s R x + t - y| is within the threshold.

    The squared residual is linear in |x|^2, |y|^2, x, y and their products, so all hypotheses meet all rows in one matrix product. Rows
    so near the threshold that its rounding could decide are computed once more in the plain way.
    """
    n, h = len(x), len(scale)
    xx, yy, tt = (x * x).sum(1), (y * y).sum(1), (trans * trans).sum(1)
    rows = np.concatenate([xx[:, None], yy[:, None], np.ones((n, 1)), x, y, (y[:, :, None] * x[:, None, :]).reshape(n, 9)], axis=1)
    back = np.einsum("hji,hj->hi", rot, trans)
    fits = np.concatenate([(scale**2)[:, None], np.ones((h, 1)), tt[:, None], 2 * scale[:, None] * back, -2 * trans, -2 * scale[:, None] * rot.reshape(h, 9)], axis=1)
    r2 = fits @ rows.T
    inside = r2 <= threshold**2
    doubt = 1e-12 * (scale**2 * xx.max(initial=0.0) + tt + yy.max(initial=0.0) + threshold**2)
    r2 -= threshold**2
    near = np.flatnonzero(np.abs(r2, out=r2) <= doubt[:, None])
    if not len(near):
        return inside
    k, i = np.divmod(near, n)
    plain = scale[k, None] * np.einsum("pij,pj->pi", rot[k], x[i]) + trans[k] - y[i]
    inside[k, i] = (plain * plain).sum(1) <= threshold**2
    return inside


def score(corr: DataFrame, hyps: DataFrame, keys: Sequence[str], ids: Sequence[str], threshold: float) -> DataFrame:
    """(keys, h, n_in, same): inliers of each hypothesis among all correspondences, and a digest of which they are.

    Correspondences travel in blocks of about BLOCK; a block meets its group's hypotheses once and sends back one count per
    hypothesis, which are added up with partial sums.
    """
    keys = list(keys)
    sizes = corr.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("__k"))
    mark = F.xxhash64(*ids)
    blocks = corr.join(sizes, keys).groupBy(*keys, F.pmod(mark, F.col("__k")).alias("__blk")).agg(
        F.collect_list(F.struct(F.shiftrightunsigned(mark, 33).alias("m"), *SRC, *DST)).alias("c"))
    rows = blocks.join(hyps, keys).select(*keys, *[F.col(f"c.{c}").alias(c) for c in ("m", *SRC, *DST)], "hs", "hr", "ht")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for *own, m, x, y, z, u, v, w, s, rot, trans in b[[*keys, "m", *SRC, *DST, "hs", "hr", "ht"]].itertuples(index=False, name=None):
                x, y, rot, trans = np.stack([x, y, z], axis=1), np.stack([u, v, w], axis=1), rot.reshape(-1, 3, 3), trans.reshape(-1, 3)
                # counts, and sums of 31-bit marks, which are exact in doubles
                weights = np.stack([np.ones(len(m)), m.astype(np.float64)], axis=1)
                sums = [inliers(x, y, s[h : h + 128], rot[h : h + 128], trans[h : h + 128], threshold).astype(np.float64) @ weights for h in range(0, len(s), 128)]
                n_in, same = np.concatenate(sums).astype(np.int64).T
                yield pd.DataFrame({**{k: [o] * len(s) for k, o in zip(keys, own)}, "h": np.arange(len(s)), "n_in": n_in, "same": same})[np.isfinite(s)]

    schema = T.StructType([rows.schema[k] for k in keys] + list(T._parse_datatype_string("h int, n_in bigint, same bigint").fields))
    return rows.mapInPandas(kernel, schema).groupBy(*keys, "h").agg(F.sum("n_in").alias("n_in"), F.sum("same").alias("same"))


def leaders(corr: DataFrame, hyps: DataFrame, keys: Sequence[str], ids: Sequence[str], threshold: float) -> DataFrame:
    """One hypothesis per group as a fit, with n_in: most inliers, then the smallest median inlier error, then the first.

    Of hypotheses with the very same inliers the first stands for all, as the refits depend on the inliers only.
    """
    keys = list(keys)
    counts = materialize(score(corr, hyps, keys, ids, threshold), "scores")
    most = counts.groupBy(*keys).agg(F.max("n_in").alias("n_in"))
    top = materialize(counts.join(most, [*keys, "n_in"]).groupBy(*keys, "n_in", "same").agg(F.min("h").alias("h")), "leaders")
    i = F.col("h")
    fits = materialize(top.join(hyps, keys).select(*keys, "h", "n_in", F.get("hs", i).alias("scale"), F.slice("hr", i * 9 + 1, F.lit(9)).alias("rot"),
                                                  F.slice("ht", i * 3 + 1, F.lit(3)).alias("trans")), "leader-fits")
    tied = fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select(*keys)
    errors = corr.join(fits.join(tied, keys, "left_semi"), keys).withColumn("err", residual()).filter(F.col("err") <= threshold)
    medians = exact_quantiles(errors, [*keys, "h"], "err", {"med": 0.5})
    best = fits.join(medians, [*keys, "h"], "left").groupBy(*keys).agg(F.min_by(F.struct("n_in", "scale", "rot", "trans"), F.struct(F.coalesce("med", F.lit(float("inf"))), "h")).alias("b"))
    return best.select(*keys, "b.*")


def ransac_sim3(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], iterations: int, threshold: float, seed: int = 0) -> DataFrame:
    """Robust similarity per group over all its correspondences, whatever their number.

    Hypotheses are drawn by hash, scored on every correspondence in blocks, and the best is refitted twice on its inliers with
    additive moments. With fewer than three inliers the fit is to all rows. Adds n_corr, n_inliers, inlier_median, inlier_p95;
    groups of fewer than three or degenerate correspondences have a NULL scale.
    """
    keys = list(keys)
    corr = materialize(corr.select(*keys, *[i for i in ids if i not in keys], *SRC, *DST), "correspondences")
    hyps = materialize(hypotheses(corr, keys, ids, iterations, seed), "hypotheses")
    best = leaders(corr, hyps, keys, ids, threshold)
    chosen = corr.join(best, keys).withColumn("err", residual()).filter((F.col("n_in") < 3) | (F.col("err") <= threshold))
    enough = F.col("n_in") >= 3
    fit = materialize(fit_sim3(chosen.drop("scale", "rot", "trans", "err"), [*keys, "n_in"]).drop("n"), "refit")
    again = with_residual(corr, fit.filter(enough), keys).filter(F.col("err") <= threshold).drop("scale", "rot", "trans", "err")
    second = materialize(fit_sim3(again, keys).filter("n >= 3").select(*keys, F.struct("scale", "rot", "trans").alias("s")), "refit")
    fit = fit.join(second, keys, "left").select(*keys, *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in ("scale", "rot", "trans")])
    fit = materialize(fit, "fit")
    errors = with_residual(corr, fit.filter("scale is not null"), keys)
    inside = errors.groupBy(*keys).agg(F.count_if(F.col("err") <= threshold).alias("n_inliers"))
    judged = errors.join(inside, keys).filter((F.col("n_inliers") == 0) | (F.col("err") <= threshold))
    stats = exact_quantiles(judged, keys, "err", {"inlier_median": 0.5, "inlier_p95": 0.95})
    sizes = corr.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_corr"))
    return sizes.join(fit, keys, "left").join(inside, keys, "left").join(stats, keys, "left").select(
        *keys, "scale", "rot", "trans", "n_corr", F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"), "inlier_median", "inlier_p95")


def stage_reason(min_corr: int, min_inliers: int, min_ratio: float, scale_range: tuple[float, float], max_p95: float) -> Column:
    """Why a segment's transform is not used; empty when it is. The first failing test counts."""
    ratio = F.col("n_inliers") / F.greatest(F.col("n_corr"), F.lit(1))
    return (F.when(F.col("n_corr") < min_corr, "too_few_corr").when(F.col("scale").isNull(), "degenerate")
            .when(F.col("n_inliers") < min_inliers, "too_few_inliers").when(ratio < min_ratio, "low_inlier_ratio")
            .when(~F.col("scale").between(*scale_range), "scale_out_of_range")
            .when(F.col("inlier_p95") > max_p95, "residual_p95_too_large").otherwise(""))


def endpoint_offset(corr: DataFrame, keys: Sequence[str], trim: float = 0.8, max_offset: float = float("inf"),
                    max_p95: float = float("inf")) -> DataFrame:
    """Median offset per axis between two sets of points of one frame, trimmed once at the residual percentile.

    A group is one frame's points (the query grid), so medians use short arrays: one aggregate, no second shuffle.
    Returns ox, oy, oz (zero when skipped), n_corr, offset_norm, residual_p95, reason.
    """
    from pathweave.functions.arrays import let, quantile

    d = F.struct(*[(F.col(b) - F.col(a)).alias(n) for a, b, n in zip(SRC, DST, "xyz")])
    g = corr.groupBy(*keys).agg(F.collect_list(d).alias("d"))

    def centre(a: Column) -> Column:
        return F.struct(*[quantile(F.transform(a, lambda s: s[c]), 0.5).alias(c) for c in "xyz"])

    def resid(a: Column, m: Column) -> Column:
        return F.transform(a, lambda s: norm(*[s[c] - m[c] for c in "xyz"]))

    def trimmed(a: Column) -> Column:
        def cut(r: Column) -> Column:
            return let(quantile(r, trim), lambda q: F.transform(
                F.filter(F.arrays_zip(a.alias("v"), r.alias("r")), lambda s: s["r"] <= q), lambda s: s["v"]))
        kept = let(let(centre(a), lambda m: resid(a, m)), cut)
        return F.when(F.size(a) >= 8, let(kept, lambda k: F.when(F.size(k) >= 3, k).otherwise(a))).otherwise(a)

    def judge(a: Column) -> Column:
        return let(centre(a), lambda m: F.struct(m.alias("m"), F.size(a).alias("n"), quantile(resid(a, m), 0.95).alias("p95")))

    g = g.select(*keys, F.size("d").alias("n0"), let(let(F.col("d"), trimmed), judge).alias("j"))
    g = g.withColumn("offset_norm", norm("j.m.x", "j.m.y", "j.m.z"))
    few = F.col("n0") < 3
    reason = (F.when(few, "too_few_corr").when(F.col("offset_norm") > max_offset, "offset_too_large")
              .when(F.col("j.p95") > max_p95, "endpoint_residual_too_large").otherwise(""))
    g = g.withColumn("reason", reason)
    return g.select(*keys, *[F.when(F.col("reason") == "", F.col(f"j.m.{c}")).otherwise(0.0).alias(f"o{c}") for c in "xyz"],
                    F.when(few, F.col("n0")).otherwise(F.col("j.n")).alias("n_corr"),
                    F.when(few, 0.0).otherwise(F.col("offset_norm")).alias("offset_norm"), F.col("j.p95").alias("residual_p95"), "reason")


def gate(corr: DataFrame, track_ok: DataFrame | None, stride: int, vis: str = "vis", min_vis: float = 0.5) -> DataFrame:
    """Correspondences used for calibration: finite on both sides, visible, on every n-th frame and of a kept track (None: the rows are of kept tracks)."""
    ok = all_finite(SRC + DST) & (F.coalesce(F.col(vis), F.lit(1)) >= min_vis) & (F.col("t") % stride == 0)
    rows = corr.filter(ok)
    return rows if track_ok is None else rows.join(track_ok.select("demo_id", "point_id"), ["demo_id", "point_id"], "left_semi")


def calibrate(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], fraction: float, iterations: int, threshold: float) -> DataFrame:
    """``ransac_sim3`` on the training part of an exact split per group, with train_rmse, val_rmse, median_err and p95_err of the fit."""
    keys = list(keys)
    corr = materialize(corr, "corr")
    split = materialize(train_val_split(corr, keys, ids, fraction, "calibration"), "split")
    fit = materialize(ransac_sim3(split.filter("split <> 'val'"), keys, ids, iterations, threshold), "fit")
    e = with_residual(split, fit.filter("scale is not null"), keys)
    plain = e.groupBy(*keys).agg(*[F.sqrt(F.avg(F.when(F.col("split").isin(s, "both"), F.col("err") * F.col("err")))).alias(f"{s}_rmse") for s in ("train", "val")])
    q = exact_quantiles(e, keys, "err", {"median_err": 0.5, "p95_err": 0.95})
    return fit.join(plain, keys, "left").join(q, keys, "left")


__all__ = ["at", "endpoint_offset", "fit_affine", "fit_sim3", "gate", "moments", "moved", "hypotheses", "leaders", "pair", "ransac_sim3", "residual", "score",
           "sim3_batch", "stage_reason", "trimmed_fit", "with_residual"]
