"""Quality audit of demos: what is missing, malformed, not finite, jumping, degenerate or mostly replaced."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.numeric import all_finite
from pathweave.operators.motion import TRACK, XYZ, steps_between
from pathweave.operators.quantile import exact_quantiles
from pathweave.session import materialize


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict; ``unit`` is the cell that first-frame points are rounded to."""

    max_step: float
    min_unique: float
    min_inlier: float
    max_changed: float
    unit: float = 1e3
    require_counts: bool = True


def audit(demos: DataFrame, catalog: DataFrame, tracks: DataFrame, counts: DataFrame, required: Sequence[str], limits: Limits) -> DataFrame:
    """One row per demo of ``demos``, with measures, the list of reasons against it, and the verdict.

    ``catalog`` lists (demo_id, key_name); ``counts`` has (demo_id, inlier_count, changed_count), null where a filter stored none.
    Demos that lack a required key get only these reasons; fewer than two frames or no point are ``bad_shape`` and are not measured further.
    Steps that are not a number are left out of the measures, as their demo is ``nonfinite`` anyway.
    """
    here = catalog.groupBy("demo_id").agg(*[F.bool_or(F.col("key_name") == k).alias(f"has_{i}") for i, k in enumerate(required)])
    first = F.max(F.when(F.col("t") == 0, F.struct(*[F.rint(F.col(c) / limits.unit).alias(c) for c in XYZ])))
    step = F.when(~F.isnan("step"), F.col("step"))
    points = steps_between(tracks).groupBy(*TRACK).agg(
        F.max(step).alias("ms"), F.count(F.lit(1)).alias("frames"), F.bool_and(all_finite(XYZ)).alias("fin"), first.alias("p0"))
    points = materialize(points, "audit-points")  # one row per track, read twice
    a = points.groupBy("demo_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("frames").alias("frames"), F.max("ms").alias("max_step"), F.bool_and("fin").alias("finite"),
        F.count_distinct("p0").alias("unique0"))
    p95 = exact_quantiles(points, ["demo_id"], "ms", {"p95": 0.95})
    a = demos.select("demo_id").join(here, "demo_id", "left").join(a, "demo_id", "left").join(p95, "demo_id", "left").join(
        counts.select("demo_id", "inlier_count", "changed_count"), "demo_id", "left")
    lacks = [~F.coalesce(F.col(f"has_{i}"), F.lit(False)) for i in range(len(required))]
    missing = F.concat_ws(";", *[F.when(no, F.lit(f"missing:{k}")) for no, k in zip(lacks, required)])
    n, frames = F.coalesce("n", F.lit(0)), F.coalesce("frames", F.lit(0))
    a = a.withColumns({"__missing": missing, "__shape": F.concat_ws("x", frames, n, F.lit(len(XYZ)))})
    there = F.col("__missing") == ""
    full = there & (frames >= 2) & (n > 0)
    ratios = {"unique0_ratio": F.col("unique0") / F.greatest(n, F.lit(1)), "inlier_ratio": F.col("inlier_count") / F.greatest(n, F.lit(1)),
              "changed_ratio": F.col("changed_count") / F.greatest(n, F.lit(1))}
    checks = [
        (~F.col("finite"), "nonfinite"),
        (F.col("inlier_count").isNull() & F.lit(limits.require_counts), "missing_filter_inlier_attr"),
        (F.col("changed_count").isNull() & F.lit(limits.require_counts), "missing_filter_changed_attr"),
        (F.col("max_step") > limits.max_step, "max_step"),
        (ratios["unique0_ratio"] < limits.min_unique, "low_unique0"),
        (ratios["inlier_ratio"] < limits.min_inlier, "low_inlier"),
        (ratios["changed_ratio"] > limits.max_changed, "too_many_replaced"),
    ]
    found = F.concat_ws(";", *[F.when(c, F.lit(name)) for c, name in checks])
    reasons = F.when(~there, F.col("__missing")).when(~full, F.lit("bad_shape")).otherwise(found)
    measured = {"finite": F.col("finite"), "num_points": n, "max_step": F.col("max_step"), "p95_point_max_step": F.col("p95"),
                "unique0": F.col("unique0"), "inlier_count": F.col("inlier_count"), "changed_count": F.col("changed_count"), **ratios}
    return a.select("demo_id", F.when(there, F.col("__shape")).alias("shape"), *[F.when(full, c).alias(k) for k, c in measured.items()],
                    reasons.alias("bad_reasons"), (reasons != "").alias("is_bad"))
