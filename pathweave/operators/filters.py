"""Whole-track filters: motion, jumps, isolated points, split-off components, visibility."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.functions.numeric import all_finite, hash_u32, text
from pathweave.operators.metric import nearest
from pathweave.operators.motion import TRACK, XYZ, point_motion
from pathweave.operators.neighbours import _split_by_size, components, equal_sizes, in_largest, knn, knn_mean, squared_distances
from pathweave.operators.quantile import robust_limits
from pathweave.operators.sequence import BLOCK, dense_index, meet
from pathweave.session import materialize

DEMO = ("demo_id",)
#: Points of a demo that are packed into one row.
DEMO_LIMIT = 1024


def teleport(exceed, max_step, n_steps, limit: float, min_steps: int = 1, use_max: bool = True, ratio: float = 0.01):
    """A track jumps when its largest step is above the limit often enough, or in the ratio mode too often."""
    if use_max:
        return (max_step > limit) & (exceed >= min_steps)
    return exceed / F.greatest(n_steps, F.lit(1)) > ratio


def first_frame_sor(points0: DataFrame, candidate: str, k: int, ratio: float, robust: bool = False) -> DataFrame:
    """Statistical outlier removal among the candidates of the first frame; adds ``mean_knn`` and ``sor``.

    Plain: keep mean_knn <= mean + ratio*(std_pop + 1e-12), everything when at most k candidates.
    Robust: keep mean_knn <= median + ratio*max(1.4826*MAD, 1e-8), everything when at most max(k, 2).
    A demo's candidates are its query points, so the group is one frame.
    """
    cand = points0.filter(F.col(candidate))
    nn = knn(cand, DEMO, "point_id", XYZ, k, known_small=True)
    m = nn.select("demo_id", "point_id", knn_mean(F.col("nn")).alias("mean_knn"))
    if robust:
        m = materialize(m, "first-frame-score")
        limits = robust_limits(m, DEMO, "mean_knn", ratio, "floor").join(m.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n")), "demo_id")
        free = max(k, 2)
    else:
        limits = m.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n"), F.avg("mean_knn").alias("mu"),
                                          F.stddev_pop("mean_knn").alias("sd"))
        limits = limits.select("demo_id", "n", (F.col("mu") + F.lit(ratio) * (F.col("sd") + F.lit(1e-12))).alias("limit"))
        free = k
    kept = m.join(limits, "demo_id").select(
        "demo_id", "point_id", "mean_knn", ((F.col("n") <= free) | (F.col("mean_knn") <= F.col("limit"))).alias("sor"))
    return points0.join(kept, ["demo_id", "point_id"], "left").withColumn("sor", F.coalesce("sor", F.lit(False)))


def nearest_donor(points0: DataFrame, inlier: str, limit: int = DEMO_LIMIT) -> DataFrame:
    """For every point that is not an inlier: the nearest inlier of the first frame, lowest id on ties.

    Demos of at most ``limit`` points are one packed row each, many of which meet as matrices at once. In larger ones two sets are
    searched on tiles (``metric.nearest``), so that no demo's inliers are gathered. Points without a finite position neither get nor
    are donors; without inliers a demo has no rows.
    """
    p = points0.filter(all_finite(XYZ) & F.col(inlier).isNotNull()).select(
        "demo_id", "point_id", F.array(*[F.col(c).cast("double") for c in XYZ]).alias("p"), F.col(inlier).alias("give"))
    p = materialize(p.withColumn("ask", ~F.col("give")), "donor-points")
    small, large = _split_by_size(p, DEMO, limit)
    found = donors_packed(small)
    if large is None:
        return found
    nn = nearest(large, DEMO, "point_id", "p", 1, ask="ask", give="give")
    return found.unionByName(nn.select("demo_id", "point_id", F.get("nn", F.lit(0))["point_id"].alias("donor"), F.get("nn", F.lit(0))["d2"].alias("d2")))


def donors_packed(points: DataFrame) -> DataFrame:
    """Nearest donors in demos that fit one row (demo_id, point_id, p, give)."""
    packed = points.groupBy(*DEMO).agg(F.sort_array(F.collect_list(F.struct("point_id", "give", "p"))).alias("r"))
    packed = packed.select(*DEMO, F.col("r.point_id").alias("ids"), F.col("r.give").alias("give"), F.flatten("r.p").alias("p"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, give, p = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("ids", "give", "p"))
            offsets, places = (b.column(c).offsets.to_numpy() for c in ("ids", "p"))
            for part in equal_sizes(np.diff(offsets)):
                n = offsets[part[0] + 1] - offsets[part[0]]
                at = offsets[part][:, None] + np.arange(n)
                xyz = p[places[part][:, None] + np.arange(n * len(XYZ))].reshape(len(part), n, len(XYZ))
                d2 = squared_distances([xyz[:, :, a] for a in range(len(XYZ))])
                d2[~np.broadcast_to(give[at][:, None, :], d2.shape)] = np.inf
                best = d2.argmin(axis=2)  # ids ascend, so ties go to the lower id
                near = np.take_along_axis(d2, best[:, :, None], axis=2)[:, :, 0]
                row, col = np.nonzero(~give[at] & np.isfinite(near))
                yield pa.RecordBatch.from_arrays([
                    b.column("demo_id").take(pa.array(part[row])), pa.array(ids[at[row, col]]), pa.array(ids[at[row, best[row, col]]]), pa.array(near[row, col])],
                    ["demo_id", "point_id", "donor", "d2"])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return packed.mapInArrow(kernel, f"demo_id {kinds['demo_id']}, point_id {kinds['point_id']}, donor {kinds['point_id']}, d2 double")


def random_donor(flags: DataFrame, inlier: str, seed: int = 0) -> DataFrame:
    """For every outlier one inlier of its demo, chosen by hash: the inliers are numbered and met by number."""
    own = flags.select("demo_id", "point_id", F.col(inlier).alias("give"))
    given = dense_index(own.filter("give").select("demo_id", F.col("point_id").alias("donor")), DEMO, ["donor"],
                        [F.shiftright("donor", 24), F.shiftright("donor", 12)], "at")
    given = materialize(given, "donors")
    n = given.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n"))
    want = own.filter("not give").join(n, "demo_id")
    want = want.withColumn("at", F.pmod(hash_u32("demo_id", "point_id", text("donor"), seed), F.col("n")).cast("int"))
    return want.join(given, ["demo_id", "at"]).select("demo_id", "point_id", "donor")


def copy_tracks(tracks: DataFrame, donors: DataFrame, cols: Sequence[str] = XYZ) -> DataFrame:
    """Replace the coordinates of every point that has a donor by the donor's, at all frames.

    Each track is sent once per receiver (itself if it keeps its data, plus the points that copy it).
    """
    pairs = donors.select("demo_id", F.col("point_id").alias("to"), F.col("donor").alias("from"))
    lost = pairs.select("demo_id", F.col("to").alias("point_id"))
    own = tracks.join(lost, ["demo_id", "point_id"], "left_anti").select("demo_id", "t", "point_id", *cols)
    copied = tracks.join(pairs.withColumnRenamed("from", "point_id"), ["demo_id", "point_id"]).select(
        "demo_id", "t", F.col("to").alias("point_id"), *cols)
    return own.unionByName(copied)


def copies(flags: DataFrame, donors: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Per demo ``picks``, the (point_id, to) by which tracks are sent: from every point that keeps its data to itself, and from donors to
    the points that copy them. ``more`` (demo_id, to and more) adds columns of the receivers. A demo's points are its query points, so the
    list is no longer than one frame."""
    pairs = donors.select("demo_id", F.col("donor").alias("point_id"), F.col("point_id").alias("to"))
    own = flags.select("demo_id", "point_id").join(donors.select("demo_id", "point_id"), ["demo_id", "point_id"], "left_anti")
    sent = pairs.unionByName(own.withColumn("to", F.col("point_id")))
    sent = sent if more is None else sent.join(more, ["demo_id", "to"])
    return sent.groupBy(*DEMO).agg(F.collect_list(F.struct(*[c for c in sent.columns if c != "demo_id"])).alias("picks"))


def moving_sor_teleport(tracks: DataFrame, motion_thresh: float, k: int, ratio: float, step_limit: float) -> DataFrame:
    """Per track: moving, sor, teleport and inlier; a demo without any inlier falls back to moving and not teleport."""
    first = F.max(F.when(F.col("t") == 0, F.struct(*XYZ)))
    m = point_motion(tracks, step_limit, carry=[first.alias("p0")])
    m = m.select("demo_id", "point_id", "path", "max_step", "exceed", "n_steps", "p0.*").withColumns({
        "moving": F.col("path") > motion_thresh,
        "teleport": teleport(F.col("exceed"), F.col("max_step"), F.col("n_steps"), step_limit)})
    m = materialize(m, "track-motion")  # one row per track, read several times below
    f = first_frame_sor(m, "moving", k, ratio)
    f = f.withColumn("strict", F.col("moving") & F.col("sor") & ~F.col("teleport"))
    any_inlier = f.groupBy("demo_id").agg(F.bool_or("strict").alias("any_inlier"))
    f = f.join(any_inlier, "demo_id")
    inlier = F.when(F.col("any_inlier"), F.col("strict")).otherwise(F.col("moving") & ~F.col("teleport"))
    return f.withColumn("inlier", inlier).drop("strict", "any_inlier")


def trajectory_distances(tracks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Sum over frames of the squared distance of every pair of tracks of a demo, as (demo_id, i, j, d2), i < j.

    One block of frames becomes one matrix in one task; only the matrices' sums are shuffled, so the volume
    is points^2 per block, not per frame.
    """
    blocks = tracks.withColumn("blk", F.floor(F.col("t") / F.lit(size)).cast("bigint"))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point_id", "t"])
        ids = pdf["point_id"].unique()
        n = len(ids)
        total = np.zeros((n, n))
        for c in XYZ:
            m = pdf[c].to_numpy(float).reshape(n, -1)
            sq = (m * m).sum(axis=1)
            total += sq[:, None] + sq[None, :] - 2.0 * (m @ m.T)
        i, j = np.triu_indices(n, 1)
        return pd.DataFrame({"demo_id": pdf["demo_id"].iloc[0], "i": ids[i], "j": ids[j], "d2": np.maximum(total[i, j], 0.0)})

    parts = blocks.select("demo_id", "blk", "t", "point_id", *XYZ).groupBy("demo_id", "blk").applyInPandas(
        partial, "demo_id bigint, i bigint, j bigint, d2 double")
    return parts.groupBy("demo_id", "i", "j").agg(F.sum("d2").alias("d2"))


def component_filter(tracks: DataFrame, candidates: DataFrame, k: int = 5, factor: float = 6.0, stride: int = 1,
                     min_bad: int = 1, min_keep_ratio: float = 0.55) -> DataFrame:
    """Flags tracks outside the largest component of the distance graph, frame-wise and over whole trajectories.

    ``candidates`` has (demo_id, point_id). Frames (or the trajectory test) that would keep too few points do not
    vote; if all votes together keep too few, only the trajectory test counts, and if that does, nothing is bad.
    Adds frame_bad, traj_bad, bad per candidate.
    """
    n = candidates.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.filter(F.col("n") >= max(4, k + 2)).withColumn("min_keep", F.greatest(F.lit(3), F.ceil(F.lit(min_keep_ratio) * F.col("n"))))
    last = tracks.groupBy("demo_id").agg(F.max("t").alias("t_max"))
    pts = meet(tracks, candidates.select("demo_id", "point_id"), ["demo_id", "point_id"]).join(n, "demo_id").join(last, "demo_id")
    traj = _trajectory_bad(pts, n, k, factor, last)  # whole trajectories, whatever the frame stride
    pts = pts.filter((F.col("t") % stride == 0) | (F.col("t") == F.col("t_max")))
    votes = frame_votes(pts, k, factor).groupBy("demo_id", "point_id").agg(F.count(F.lit(1)).alias("votes"))

    f = candidates.select("demo_id", "point_id").join(n, "demo_id", "left").join(votes, ["demo_id", "point_id"], "left").join(
        traj, ["demo_id", "point_id"], "left")
    f = f.withColumns({"frame_bad": F.coalesce(F.col("votes") >= max(1, min_bad), F.lit(False)),
                       "traj_bad": F.coalesce("traj_bad", F.lit(False))})
    both = F.col("frame_bad") | F.col("traj_bad")
    g = f.groupBy("demo_id").agg(F.count_if(~both).alias("keep_both"), F.count_if(~F.col("traj_bad")).alias("keep_traj"),
                                 F.bool_or("traj_bad").alias("any_traj"), F.max("min_keep").alias("mk"))
    f = f.join(g, "demo_id")
    bad = (F.when(F.col("mk").isNull(), F.lit(False)).when(F.col("keep_both") >= F.col("mk"), both)
           .when(F.col("any_traj") & (F.col("keep_traj") >= F.col("mk")), F.col("traj_bad")).otherwise(F.lit(False)))
    return f.withColumn("bad", bad).select("demo_id", "point_id", "frame_bad", "traj_bad", "bad")


def frame_votes(pts: DataFrame, k: int, factor: float) -> DataFrame:
    """(demo_id, point_id) once per frame that finds the point outside its largest component (``pts``: demo_id, t, point_id, xyz, min_keep).

    A frame's points are one packed row (its query grid), whose neighbours, limit and components are found in one go. The limit is that
    of ``robust_upper`` of kind mean over the finite scores; frames without one, or that would keep fewer than min_keep points, do not vote.
    """
    p = pts.groupBy("demo_id", "t").agg(F.sort_array(F.collect_list(F.struct("point_id", *XYZ))).alias("p"), F.max("min_keep").alias("min_keep"))
    packed = p.select("demo_id", "min_keep", F.col("p.point_id").alias("ids"), *[F.col(f"p.{c}").cast("array<double>").alias(c) for c in XYZ])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in equal_sizes(b["ids"].map(len).to_numpy()):
                q = b.iloc[part]
                d2 = squared_distances([np.stack(q[c]) for c in XYZ])
                label, ok = frame_components(d2, k, factor)
                big = in_largest(label)
                ok &= big.sum(axis=1) >= q["min_keep"].to_numpy()
                at, i = np.nonzero(~big & ok[:, None])
                yield pd.DataFrame({"demo_id": q["demo_id"].to_numpy()[at], "point_id": np.stack(q["ids"])[at, i]})

    return packed.mapInPandas(kernel, "demo_id bigint, point_id bigint")


def frame_components(d2: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of many frames of n points (squared distances, (frames, n, n)), and whether a frame has a usable limit."""
    f, n = d2.shape[:2]
    if n < 2:
        return np.zeros((f, n), int), np.zeros(f, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        near = d2.copy()
        near[:, np.arange(n), np.arange(n)] = np.inf
        score = np.sqrt(np.sort(near, axis=2)[:, :, : min(k, n - 1)]).mean(axis=2)
        finite = np.isfinite(score)
        m = finite.sum(axis=1)
        mid = np.maximum(m - 1, 0) // 2

        def middle(x):
            return np.sort(np.where(finite, x, np.inf), axis=1)[np.arange(f), mid][:, None]

        med = middle(score)
        mad = middle(np.abs(score - med))[:, 0]
        mu = np.where(finite, score, 0.0).sum(axis=1) / m
        sd = np.sqrt((np.where(finite, score - mu[:, None], 0.0) ** 2).sum(axis=1) / m)
        limit = np.where(mad > 1e-12, med[:, 0] + factor * 1.4826 * mad, mu + factor * (sd + 1e-12))
        return components(np.sqrt(d2) <= limit[:, None, None]), (m > 0) & (limit > 0) & (limit < np.inf)


def _trajectory_bad(pts: DataFrame, n: DataFrame, k: int, factor: float, last: DataFrame) -> DataFrame:
    """Component test on whole trajectories: one packed distance list per demo (points^2 entries)."""
    d = trajectory_distances(pts).join(last, "demo_id")
    d = d.select("demo_id", "i", "j", (F.sqrt("d2") / F.sqrt(F.col("t_max") + 1.0)).alias("d"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        m = len(ids)
        dist = np.full((m, m), np.inf)
        i, j = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        dist[i, j] = dist[j, i] = pdf["d"]
        score = np.sort(dist, axis=1)[:, : min(k, m - 1)].mean(axis=1)
        med = np.sort(score)[(m - 1) // 2]
        mad = np.sort(np.abs(score - med))[(m - 1) // 2]
        thr = med + factor * 1.4826 * mad if mad > 1e-12 else score.mean() + factor * (score.std() + 1e-12)
        linked = dist <= thr
        np.fill_diagonal(linked, True)
        label = np.arange(m)
        while True:
            new = np.where(linked, label[None, :], m).min(axis=1)
            if np.array_equal(new, label):
                break
            label = new
        counts = np.bincount(label, minlength=m)
        keep = label == int(counts.argmax())
        need = max(3, int(pdf["min_keep"].iloc[0]))
        ok = thr > 0 and keep.sum() >= need
        return pd.DataFrame({"demo_id": pdf["demo_id"].iloc[0], "point_id": ids, "traj_bad": ~keep & bool(ok)})

    return d.join(n.select("demo_id", "min_keep"), "demo_id").groupBy("demo_id").applyInPandas(
        judge, "demo_id bigint, point_id bigint, traj_bad boolean")


def visibility_filter(rows: DataFrame, keys: Sequence[str], k_col: str = "k", vis: str = "vis") -> DataFrame:
    """Keep points visible on at least half of the keyframes and on the first; keep all if too few would remain."""
    p = rows.groupBy(*keys, "point_id").agg(
        F.avg(F.when(F.col(vis) > 0.5, 1.0).otherwise(0.0)).alias("share"),
        F.max(F.when(F.col(k_col) == 0, F.col(vis) > 0.5)).alias("first"))
    p = p.withColumn("own", (F.col("share") >= 0.5) & F.col("first"))
    w = W.partitionBy(*keys)  # one sample's points
    return p.withColumns({"n_keep": F.count_if("own").over(w), "n_all": F.count(F.lit(1)).over(w)}).withColumn(
        "keep", F.when(F.col("n_keep") < F.greatest(F.lit(3.0), F.rint(F.col("n_all") * 0.15)), F.lit(True)).otherwise(F.col("own")))
