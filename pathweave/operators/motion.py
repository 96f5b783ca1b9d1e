"""Frame-to-frame motion of point tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.numeric import norm
from pathweave.operators.sequence import BLOCK, over_neighbours

TRACK = ("demo_id", "point_id")
XYZ = ("xu", "yu", "zu")


def forward_flow(df: DataFrame, keys: Sequence[str] = TRACK, t: str = "t", cols: Sequence[str] = XYZ,
                 size: int = BLOCK) -> DataFrame:
    """p[t+1] - p[t] per coordinate, zero on the last frame."""
    return over_neighbours(
        df, keys, t, lambda w: {f"d{c}": F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0)) for c in cols},
        before=0, after=1, size=size)


def backward_flow(df: DataFrame, keys: Sequence[str] = TRACK, t: str = "t", cols: Sequence[str] = XYZ,
                  size: int = BLOCK) -> DataFrame:
    """p[t] - p[t-1] per coordinate, zero on the first frame."""
    return over_neighbours(
        df, keys, t, lambda w: {f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in cols},
        before=1, after=0, size=size)


def steps_between(df: DataFrame, keys: Sequence[str] = TRACK, t: str = "t", cols: Sequence[str] = XYZ,
                  size: int = BLOCK) -> DataFrame:
    """Length of the step that leads to each frame; NULL on the first frame."""
    def make(w):
        prev = [F.col(c) - F.lag(c).over(w) for c in cols]
        return {"step": norm(*prev)}
    return over_neighbours(df, keys, t, make, before=1, after=0, size=size)


def second_difference(df: DataFrame, keys: Sequence[str] = TRACK, t: str = "t", cols: Sequence[str] = XYZ,
                      carry: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """x[t+1] - 2x[t] + x[t-1] on interior frames; ``carry`` columns get the minimum over the three frames."""
    def make(w):
        out = {f"dd{c}": F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w) for c in cols}
        out |= {f"{c}3": F.least(F.lead(c).over(w), F.col(c), F.lag(c).over(w)) for c in carry}
        return out
    out = over_neighbours(df, keys, t, make, before=1, after=1, size=size)
    return out.filter(F.col(f"dd{cols[0]}").isNotNull())


def point_motion(df: DataFrame, step_limit: float, keys: Sequence[str] = TRACK, carry: Sequence = ()) -> DataFrame:
    """Per track: path length, largest step, number of steps above the limit, number of steps."""
    return steps_between(df, keys).groupBy(*keys).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"),
        F.max("step").alias("max_step"),
        F.count_if(F.col("step") > step_limit).alias("exceed"),
        F.count("step").alias("n_steps"),
        *carry,
    )


def clamped_std(total, total_sq, n, floor: float = 0.0):
    """Population deviation from moments with the variance clamped from below."""
    m = total / n
    return F.sqrt(F.greatest(total_sq / n - m * m, F.lit(floor)))
