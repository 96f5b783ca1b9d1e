"""Fixed-size picks, splits and resampling along time. Random choices are hashes of ids, purpose and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.numeric import clip, hash_u32, hash_unit, text
from pathweave.operators.sequence import dense_index, first_n, over_neighbours


def subsample(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n: int, purpose: str, seed: int = 0) -> DataFrame:
    """n rows per key without replacement (all rows when there are fewer), the ones with the lowest hash."""
    h = df.withColumn("__h", hash_u32(*keys, *ids, text(purpose), seed))
    return first_n(h, keys, [F.col("__h"), *[F.col(i) for i in ids]], n, salt_by=ids).drop("__h", "rank")


def hash_ranked(df: DataFrame, keys: Sequence[str], ids: Sequence[str], purpose: str, seed: int = 0,
                out: str = "rank") -> DataFrame:
    """Zero-based position of each row in the hash order of its key; a hot key is spread over hash ranges."""
    h = df.withColumn("__h", hash_u32(*keys, *ids, text(purpose), seed))
    levels = [F.floor(F.col("__h") / F.lit(2**22)), F.floor(F.col("__h") / F.lit(2**12))]
    return dense_index(h, keys, ["__h", *ids], levels, out).drop("__h")


def split_sizes(n: Column, fraction: float, rule: str) -> Column:
    """Validation size for n rows: ``truncate`` int(n*f); ``calibration`` half-even rounded, at least 1, at most n-3."""
    if rule == "truncate":
        return F.floor(n * F.lit(fraction)).cast("bigint")
    return F.least(F.greatest(F.rint(n * F.lit(min(fraction, 0.8))).cast("bigint"), F.lit(1)), n - 3)


def train_val_split(df: DataFrame, keys: Sequence[str], ids: Sequence[str], fraction: float, rule: str = "truncate",
                    seed: int = 0) -> DataFrame:
    """Exact-size split per key: column ``split`` is val for the first rows in hash order. The calibration rule
    uses every row for both when a key has fewer than 8 rows (split = both)."""
    ranked = hash_ranked(df, keys, ids, "split", seed, "__rank")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    out = ranked.join(sizes, list(keys))
    split = F.when(F.col("__rank") < split_sizes(F.col("__n"), fraction, rule), "val").otherwise("train")
    if rule == "calibration":
        split = F.when(F.col("__n") < 8, "both").otherwise(split)
    return out.withColumn("split", split).drop("__rank", "__n")


def linspace_index(i: Column, m: Column, n: int, rounding: str) -> Column:
    """Index of the i-th of n evenly spaced picks among m rows; the samplers truncate, the viewer rounds."""
    pos = i * (m - 1) / F.lit(max(n - 1, 1))
    return (F.rint(pos) if rounding == "round" else F.floor(pos)).cast("int")


def stratified_indices(m: Column, n: int, keys: Sequence[str], randomness: float = 0.4, seed: int = 0) -> Column:
    """Sorted array of n picks: even spacing, inner ones moved by at most ``randomness`` of a step."""
    step = (m - 1) / F.lit(n - 1)

    def pick(i: Column) -> Column:
        u = hash_unit(*keys, text("strat"), i, seed)
        shift = F.when((i == 0) | (i == n - 1), F.lit(0.0)).otherwise((u * 2 - 1) * step * F.lit(randomness))
        return F.floor(clip(i * step + shift, F.lit(0.0), (m - 1).cast("double"))).cast("int")

    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pick))


def random_indices(m: Column, n: int, keys: Sequence[str], include_first: bool = True, seed: int = 0) -> Column:
    """Sorted array of n picks with replacement, the first one fixed to row 0 when asked for."""
    first = 1 if include_first else 0
    body = F.transform(F.sequence(F.lit(first), F.lit(n - 1)),
                       lambda i: F.pmod(hash_u32(*keys, text("rand"), i, seed), m).cast("int"))
    return F.array_sort(F.concat(F.array(F.lit(0)), body) if include_first else body)


def oversample(lengths: DataFrame, keys: Sequence[str], m: str, n: int, seed: int = 0) -> DataFrame:
    """Row positions (r, t) that bring every key to n rows: all m rows once, then hash-chosen repeats."""
    r = lengths.filter(F.col(m) > 0).withColumn("r", F.explode(F.sequence(F.lit(0), F.greatest(F.col(m), F.lit(n)).cast("int") - 1)))
    pick = F.pmod(hash_u32(*keys, text("over"), F.col("r"), seed), F.col(m)).cast("int")
    return r.withColumn("t", F.when(F.col("r") < F.col(m), F.col("r")).otherwise(pick))


def history_indices(s: Column, k: int, stride: int) -> Column:
    """The last k frame indices that end at or before s, front-padded with the earliest one."""
    start = F.greatest(s - (k - 1) * stride, F.lit(0))
    seq = F.sequence(start, s, F.lit(stride))
    return F.concat(F.array_repeat(start, F.lit(k) - F.size(seq)), seq)


def pad_or_trim(df: DataFrame, lengths: DataFrame, length: int | Column, keys: Sequence[str], cols: Sequence[str],
                mode: str = "edge", t: str = "t", t_len: str = "t_len") -> DataFrame:
    """Exactly ``length`` frames per key: cut, or filled with the last row, zeros or ones."""
    length = length if isinstance(length, Column) else F.lit(length)
    want = lengths.select(*keys, t_len, F.explode(F.sequence(F.lit(0), length - 1)).alias("__want"))
    src = want.withColumn(t, F.least(F.col("__want"), F.col(t_len) - 1)).join(df.select(*keys, t, *cols), [*keys, t], "left")
    fill = {"edge": None, "zeros": 0, "ones": 1}[mode]
    out = {c: F.col(c) if fill is None else F.when(F.col("__want") < F.col(t_len), F.col(c)).otherwise(F.lit(fill)) for c in cols}
    return src.withColumns(out).drop(t, t_len).withColumnRenamed("__want", t)


def upsample_linear(src: DataFrame, lengths: DataFrame | None, stride: int, keys: Sequence[str], cols: Sequence[str],
                    ts: str = "ts") -> DataFrame:
    """Values at every frame from values at every ``stride``-th one.

    A source row looks at the next one and gives the frames up to it; the last one holds to the end. Frames whose next source row is
    missing are left out. ``src`` may carry the demo's t_len, then ``lengths`` is None."""
    rows = src if lengths is None else src.join(lengths, "demo_id")
    rows = rows.withColumn("__n", F.floor((F.col("t_len") - 1) / stride).cast("int")).filter(F.col(ts) <= F.col("__n"))
    rows = over_neighbours(rows, keys, ts, lambda w: {"__next": F.lead(ts).over(w), **{f"__r_{c}": F.lead(c).over(w) for c in cols}}, before=0, after=1)
    alone = F.col(ts) == F.col("__n")
    rows = rows.filter(alone | (F.col("__next") == F.col(ts) + 1))
    rows = rows.withColumn("t", F.explode(F.sequence(F.col(ts) * stride, F.least(F.col(ts) * stride + stride - 1, F.col("t_len") - 1))))
    f = (F.col("t") - F.col(ts) * stride) / F.lit(float(stride))
    return rows.select(*keys, "t", *[F.when(alone, F.col(c).cast("double")).otherwise(F.col(c) * (1.0 - f) + F.col(f"__r_{c}") * f).alias(c) for c in cols])
