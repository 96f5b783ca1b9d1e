"""Fits of groups whose rows fit one task: the operators of ``calibration`` on a whole group at once.

Groups that may hold a large share of the data take several passes over written tables there. Where a group is known to be small, its rows
are gathered once (not at all where the frames were brought together before their points were written out) and everything that is asked
of the group is worked out on its arrays. Results are the same: draws, ties, gates and quantiles follow the same rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.operators import calibration as cal

#: Hypotheses that meet a group's rows at once, as residuals held by one task.
CELLS = 1 << 20


def by_group(rows: DataFrame, gather: Sequence[str], keys: Sequence[str], kernel: Callable, fields: str) -> DataFrame:
    """``kernel`` of every group of ``keys``, as one row per group or as several.

    Rows are gathered by ``gather``, some of the keys; all groups of one gathering are handed over together: columns as arrays, ordered by
    group, and the bounds of the groups. It returns the columns of ``fields``, of which the first may be ``__g``, the group of each row.
    """
    keys, gather = list(keys), list(gather)
    rest = [k for k in keys if k not in gather]
    more = T._parse_datatype_string(fields)
    own = [f for f in more.fields if f.name != "__g"]
    schema = T.StructType([rows.schema[k] for k in keys] + own)

    def run(table: pa.Table) -> pa.Table:
        if rest:
            table = table.sort_by([(k, "ascending") for k in rest])
        cols = {c: table.column(c).to_numpy() for c in table.column_names if c not in gather or c in keys}
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for k in rest:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(new)
        made = kernel(cols, np.append(starts, n))
        at = pa.array(starts[made.pop("__g")] if "__g" in made else starts)
        return pa.table({**{k: table.column(k).take(at) for k in keys}, **{f.name: pa.array(made[f.name], from_pandas=True) for f in own}})

    run_typed = _typed(run, schema)
    return rows.groupBy(*gather).applyInArrow(run_typed, schema)


def _typed(run: Callable[[pa.Table], pa.Table], schema: T.StructType) -> Callable[[pa.Table], pa.Table]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def typed(table: pa.Table) -> pa.Table:
        return run(table).cast(arrow)

    return typed


def hashes(columns: Sequence[np.ndarray], *tail: str | int) -> np.ndarray:
    """``functions.numeric.hash_u32`` of whole numbers and fixed parts."""
    form = ("|".join(["%d"] * len(columns)) + "".join(f"|{p}" for p in tail)).encode()
    md5 = hashlib.md5
    return np.frombuffer(b"".join([md5(form % ids).digest()[:4] for ids in zip(*[c.tolist() for c in columns])]), ">u4").astype(np.int64)


def quantile(v: np.ndarray, p: float) -> float:
    """As ``quantile.exact_quantiles``; NULL (NaN) for no values."""
    if not len(v):
        return np.nan
    pos = p * (len(v) - 1)
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    part = np.partition(v, (lo, hi))
    return float(part[lo] if part[lo] == part[hi] else part[lo] + (part[hi] - part[lo]) * (pos - lo))


def fit(x: np.ndarray, y: np.ndarray):
    """Similarity of one set of correspondences from the same moments as ``calibration.fit_sim3``: scale (NaN where there is none), rot, trans."""
    scale, rot, trans = cal.sim3_batch(np.array([float(len(x))]), x.sum(0)[None], y.sum(0)[None], np.array([(x * x).sum()]), (y.T @ x)[None])
    return float(scale[0]), rot[0], trans[0]


def errors(x: np.ndarray, y: np.ndarray, f) -> np.ndarray:
    scale, rot, trans = f
    d = scale * (x @ rot.T) + trans - y
    return np.sqrt((d * d).sum(1))


@lru_cache(4096)
def draws(pool: int, iterations: int, seed: int) -> np.ndarray:
    """The different draws among those of ``calibration.draw_positions``, in the order of their first occurrence."""
    at = cal.draw_positions(pool, iterations, seed)
    return at[np.sort(np.unique(at, axis=0, return_index=True)[1])]


def _pool(ids: list[np.ndarray], keys: list[np.ndarray], iterations: int, seed: int) -> np.ndarray:
    """Rows of a group from which hypotheses are drawn, in the order of the draws."""
    take = np.arange(len(ids[0]))
    if len(take) > 4 * iterations:
        take = np.lexsort([*ids[::-1], hashes(keys + ids, "ransac", seed)])[: 4 * iterations]
    ids, keys = [i[take] for i in ids], [k[take] for k in keys]
    return take[np.lexsort([*ids[::-1], hashes(keys + ids, "order", seed)])]


def _drawn(x: np.ndarray, y: np.ndarray, pools: list[np.ndarray], iterations: int, seed: int):
    """Hypotheses of several groups, fitted in one batch: scale, rot, trans of all and the group each belongs to."""
    at = [p[draws(len(p), iterations, seed)] for p in pools]
    out = []
    for size in sorted({a.shape[1] for a in at}):
        own = [g for g, a in enumerate(at) if a.shape[1] == size]
        rows = np.concatenate([at[g] for g in own])
        u, v = x[rows], y[rows]
        cu, cv = u.mean(axis=1), v.mean(axis=1)  # centred, against cancellation
        u, v = u - cu[:, None], v - cv[:, None]
        zero = np.zeros((len(rows), 3))
        scale, rot, _ = cal.sim3_batch(np.full(len(rows), float(size)), zero, zero, (u**2).sum(axis=(1, 2)), np.einsum("hki,hkj->hij", v, u))
        out.append((np.repeat(own, [len(at[g]) for g in own]), scale, rot, cv - scale[:, None] * np.einsum("hij,hj->hi", rot, cu)))
    group = np.concatenate([o[0] for o in out])
    order = np.argsort(group, kind="stable")
    return [np.concatenate([o[i] for o in out])[order] for i in range(4)]


def _leader(x, y, scale, rot, trans, threshold):
    """(inliers, hypothesis) as ``calibration.leaders`` chooses it; None without a usable hypothesis."""
    use = np.isfinite(scale)
    if not use.any():
        return None
    scale, rot, trans = scale[use], rot[use], trans[use]
    step = max(1, CELLS // len(x))
    inside = np.concatenate([cal.inliers(x, y, scale[h : h + step], rot[h : h + step], trans[h : h + step], threshold) for h in range(0, len(scale), step)])
    n_in = inside.sum(axis=1)
    top = np.flatnonzero(n_in == n_in.max())
    if len(top) > 1:
        seen = dict(zip((m.tobytes() for m in np.packbits(inside[top[::-1]], axis=1)), top[::-1]))  # the first of equals stays
        top = np.array(sorted(seen.values()))
    best = top[0]
    if len(top) > 1 and n_in[best]:
        err = [errors(x, y, (scale[h], rot[h], trans[h])) for h in top]
        best = top[int(np.argmin([quantile(e[e <= threshold], 0.5) for e in err]))]
    return int(n_in[best]), (scale[best], rot[best], trans[best])


def robust(x: np.ndarray, y: np.ndarray, leader, threshold: float):
    """Refits of ``calibration.ransac_sim3`` and what it tells of them: fit or None, n_inliers, median, p95."""
    if leader is None:
        return None, 0, np.nan, np.nan
    n_in, f = leader
    keep = errors(x, y, f) <= threshold if n_in >= 3 else np.ones(len(x), bool)
    f = fit(x[keep], y[keep])
    if n_in >= 3 and np.isfinite(f[0]):
        keep = errors(x, y, f) <= threshold
        if keep.sum() >= 3:
            f = fit(x[keep], y[keep])
    if not np.isfinite(f[0]):
        return f, 0, np.nan, np.nan
    e = errors(x, y, f)
    inside = e <= threshold
    judged = e[inside] if inside.any() else e
    return f, int(inside.sum()), quantile(judged, 0.5), quantile(judged, 0.95)


def xyz(cols: dict, names: Sequence[str]) -> np.ndarray:
    return np.stack([cols[c].astype(float) for c in names], axis=1)


def _fit_columns(fits: list) -> dict:
    return {"scale": [None if f is None or not np.isfinite(f[0]) else f[0] for f in fits],
            "rot": [None if f is None else f[1].ravel() for f in fits], "trans": [None if f is None else f[2] for f in fits]}


def _ransac(x, y, ids, keys, bounds, iterations, threshold, seed):
    """``robust`` of every group; groups of fewer than three rows have no hypotheses."""
    spans = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
    usable = [g for g, s in enumerate(spans) if s.stop - s.start >= 3]
    leader: list = [None] * len(spans)
    # as many groups at once as keep the hypotheses of one batch short
    for some in np.array_split(usable, max(1, len(usable) * iterations // (1 << 15))):
        if len(some):
            pools = [spans[g].start + _pool([i[spans[g]] for i in ids], [k[spans[g]] for k in keys], iterations, seed) for g in some]
            group, *hyps = _drawn(x, y, pools, iterations, seed)
            cut = np.searchsorted(group, np.arange(len(some) + 1))
            for j, g in enumerate(some):
                leader[g] = _leader(x[spans[g]], y[spans[g]], *[h[cut[j] : cut[j + 1]] for h in hyps], threshold)
    return [robust(x[s], y[s], one, threshold) for s, one in zip(spans, leader)]


def ransac_sim3(corr: DataFrame, gather: Sequence[str], keys: Sequence[str], ids: Sequence[str], iterations: int, threshold: float, seed: int = 0) -> DataFrame:
    """``calibration.ransac_sim3`` of small groups; keys and ids are whole numbers."""
    keys = list(keys)
    corr = corr.select(*keys, *[i for i in ids if i not in keys], *cal.SRC, *cal.DST)

    def kernel(cols: dict, bounds: np.ndarray) -> dict:
        found = _ransac(xyz(cols, cal.SRC), xyz(cols, cal.DST), [cols[i] for i in ids], [cols[k] for k in keys], bounds, iterations, threshold, seed)
        return {**_fit_columns([f[0] for f in found]), "n_corr": np.diff(bounds), "n_inliers": [f[1] for f in found],
                "inlier_median": np.array([f[2] for f in found]), "inlier_p95": np.array([f[3] for f in found])}

    return by_group(corr, gather, keys, kernel, f"{cal.FIT}, n_corr bigint, n_inliers bigint, inlier_median double, inlier_p95 double")


def trimmed_fit(corr: DataFrame, keys: Sequence[str], percentile: float = 0.95, rounds: int = 2, min_points: int = 16) -> DataFrame:
    """``calibration.trimmed_fit`` of small groups."""
    def one(x, y):
        f = fit(x, y)
        for _ in range(rounds):
            e = errors(x, y, f)
            e = np.where(np.isfinite(f[0]), e, np.nan)
            keep = e <= quantile(e[~np.isnan(e)], percentile)
            if keep.sum() < min_points:
                break
            x, y = x[keep], y[keep]
            f = fit(x, y)
        return float(len(x)), f

    def kernel(cols: dict, bounds: np.ndarray) -> dict:
        x, y = xyz(cols, cal.SRC), xyz(cols, cal.DST)
        found = [one(x[a:b], y[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return {"n": [f[0] for f in found], **_fit_columns([f[1] for f in found])}

    return by_group(corr.select(*keys, *cal.SRC, *cal.DST), keys, keys, kernel, f"n double, {cal.FIT}")


def split_fits(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], parts: int, threshold: float) -> DataFrame:
    """``calibration.split_fits`` of small groups."""
    corr = corr.select(*keys, cal.hash_class(keys, ids, parts).cast("int").alias("h"), *cal.SRC, *cal.DST)

    def kernel(cols: dict, bounds: np.ndarray) -> dict:
        out = []
        for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            x, y, h = *(xyz({c: v[a:b] for c, v in cols.items()}, names) for names in (cal.SRC, cal.DST)), cols["h"][a:b]
            for one in range(parts):
                f = fit(x[h == one], y[h == one])
                if np.isfinite(f[0]):
                    e = errors(x, y, f)
                    out.append((g, one, len(e), int((e <= threshold).sum()), quantile(e, 0.5)))
        return dict(zip(("__g", "h", "n", "n_inliers", "median_err"), (np.array(c) for c in zip(*out)) if out else [np.array([], int)] * 5))

    return by_group(corr, keys, keys, kernel, "__g int, h bigint, n bigint, n_inliers bigint, median_err double")


def calibrate(corr: DataFrame, keys: Sequence[str], ids: Sequence[str], fraction: float, iterations: int, threshold: float) -> DataFrame:
    """``calibration.calibrate`` of small groups."""
    corr = corr.select(*keys, *[i for i in ids if i not in keys], *cal.SRC, *cal.DST)

    def kernel(cols: dict, bounds: np.ndarray) -> dict:
        x, y = xyz(cols, cal.SRC), xyz(cols, cal.DST)
        out, fits = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n, own, names = b - a, [cols[k][a:b] for k in keys], [cols[i][a:b] for i in ids]
            train = val = np.ones(n, bool)
            if n >= 8:
                val = np.zeros(n, bool)
                val[np.lexsort([*names[::-1], hashes(own + names, "split", 0)])[: min(max(round(n * min(fraction, 0.8)), 1), n - 3)]] = True
                train = ~val
            u, v = x[a:b], y[a:b]
            f, *told = _ransac(u[train], v[train], [i[train] for i in names], [k[train] for k in own], np.array([0, train.sum()]), iterations, threshold, 0)[0]
            e = errors(u, v, f) if f is not None and np.isfinite(f[0]) else np.full(n, np.nan)
            fits.append(f)
            out.append((train.sum(), *told, np.sqrt((e[train] ** 2).mean()), np.sqrt((e[val] ** 2).mean()), quantile(e, 0.5), quantile(e, 0.95)))
        names = ("n_corr", "n_inliers", "inlier_median", "inlier_p95", "train_rmse", "val_rmse", "median_err", "p95_err")
        return {**_fit_columns(fits), **dict(zip(names, (np.array(c) for c in zip(*out))))}

    return by_group(corr, keys, keys, kernel, f"{cal.FIT}, n_corr bigint, n_inliers bigint, inlier_median double, inlier_p95 double, "
                    "train_rmse double, val_rmse double, median_err double, p95_err double")


def image_totals(images: DataFrame, limit: float) -> DataFrame:
    """Sum of every image (demo_id, t, z) and whether the median of all positive depths of its demo is above ``limit`` (null without any)."""
    schema = T.StructType([images.schema["demo_id"], images.schema["t"], *T._parse_datatype_string("was_mm boolean, total double").fields])

    def run(table: pa.Table) -> pa.Table:
        z = table.column("z").combine_chunks()
        v = z.flatten().to_numpy(zero_copy_only=False)
        total = np.bincount(np.repeat(np.arange(len(z)), np.diff(z.offsets.to_numpy())), weights=v, minlength=len(z))
        seen = v[v > 0]
        above = bool(quantile(seen, 0.5) > limit) if len(seen) else None
        return pa.table({"demo_id": table.column("demo_id"), "t": table.column("t"), "was_mm": pa.array([above] * len(z), pa.bool_()), "total": total})

    return images.groupBy("demo_id").applyInArrow(_typed(run, schema), schema)
