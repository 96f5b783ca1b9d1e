"""Order statistics of short array columns (per-frame or per-track-set values, bounded by the query grid)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (inner lambdas would otherwise compute it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite_only(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def quantile_sorted(a: Column, p: float) -> Column:
    """Linear interpolation at rank p*(n-1) of an ascending array; NULL when empty."""
    pos = F.lit(p) * (F.size(a) - 1)
    lo, hi = F.get(a, F.floor(pos).cast("int")), F.get(a, F.ceil(pos).cast("int"))
    return F.when(F.size(a) > 0, lo + (hi - lo) * (pos - F.floor(pos)))


def quantile(a: Column, p: float) -> Column:
    return let(F.sort_array(a), lambda s: quantile_sorted(s, p))


def lower_median(a: Column) -> Column:
    return F.get(F.sort_array(a), F.floor((F.size(a) - 1) / 2).cast("int"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def std_pop(a: Column) -> Column:
    return let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)))


def robust_upper(a: Column, factor: float, kind: str, margin: float = 1e-6) -> Column:
    """Upper threshold of an array of values.

    mean:   lower median + f*1.4826*MAD; mean + f*(std+1e-12) when MAD <= 1e-12; +inf when empty
    iqr:    median + f*1.4826*MAD; else Q75 + f*IQR when IQR > 1e-8; else the maximum
    margin: median + f*sigma with sigma = 1.4826*MAD, but median + margin when sigma < margin
    floor:  median + f*max(1.4826*MAD, 1e-8)
    """
    if kind not in ("mean", "iqr", "margin", "floor"):
        raise ValueError(kind)
    median = lower_median if kind == "mean" else lambda x: quantile(x, 0.5)

    def with_spread(a: Column, med: Column, mad: Column) -> Column:
        wide = med + F.lit(factor * 1.4826) * mad
        if kind == "mean":
            return F.when(mad > 1e-12, wide).otherwise(mean(a) + F.lit(factor) * (std_pop(a) + F.lit(1e-12)))
        if kind == "margin":
            sigma = F.lit(1.4826) * mad
            return F.when(sigma < margin, med + F.lit(margin)).otherwise(med + F.lit(factor) * sigma)
        if kind == "floor":
            return med + F.lit(factor) * F.greatest(F.lit(1.4826) * mad, F.lit(1e-8))
        q25, q75 = quantile(a, 0.25), quantile(a, 0.75)
        by_range = F.when(q75 - q25 > 1e-8, q75 + F.lit(factor) * (q75 - q25)).otherwise(F.array_max(a))
        return F.when(mad > 1e-8, wide).otherwise(by_range)

    def with_median(a: Column, med: Column) -> Column:
        return let(median(F.transform(a, lambda v: F.abs(v - med))), lambda mad: with_spread(a, med, mad))

    def threshold(a: Column) -> Column:
        return F.when(F.size(a) == 0, F.lit(float("inf"))).otherwise(let(median(a), lambda med: with_median(a, med)))

    return let(finite_only(a), threshold)


def channels_last(values: Column, shape: Column) -> Column:
    """Flat picture in row, column, colour order with three colours, from a flat array and its shape.

    Dimensions of one are dropped. Two dimensions are grey and repeated; three end with 3 or 4 colours, of which three stay, or
    begin with them. Any other shape gives null.
    """
    def of(s: Column) -> Column:
        planes = F.flatten(F.transform(F.sequence(F.lit(0), F.get(s, F.lit(1)) * F.get(s, F.lit(2)) - 1), lambda p: F.array(
            *[F.get(values, p + c * F.get(s, F.lit(1)) * F.get(s, F.lit(2))) for c in range(3)])))
        last, first = F.get(s, F.lit(2)).isin(3, 4), F.get(s, F.lit(0)).isin(3, 4)
        return (F.when(F.size(s) == 2, F.flatten(F.transform(values, lambda x: F.array(x, x, x))))
                .when((F.size(s) == 3) & last, F.filter(values, lambda _, i: i % F.get(s, F.lit(2)) < 3))
                .when((F.size(s) == 3) & first, planes))

    return let(F.filter(shape, lambda n: n != 1), of)
