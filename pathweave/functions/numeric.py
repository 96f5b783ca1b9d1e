"""Numeric column helpers. Everything here is a built-in expression and stays in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """False for NULL, NaN and both infinities."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def all_finite(cols: Iterable[Column | str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & is_finite(c)
    return out


def r6(c: Column | str) -> Column:
    """Half-even to six decimals; adding zero turns a negative zero into a plain one."""
    return F.rint(col(c).cast("double") * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


def round_half_even(c: Column | str, decimals: int = 0) -> Column:
    scale = float(10**decimals)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(c, lo), hi)


def nan_to_zero(c: Column | str) -> Column:
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def safe_divide(num: Column, den: Column, eps: float = 1e-8) -> Column:
    return num / F.greatest(den, F.lit(eps))


def norm(*cols: Column | str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        v = col(c).cast("double")
        total = total + v * v
    return F.sqrt(total)


def hash_u32(*parts: Column | str | int) -> Column:
    """A reproducible 32-bit number from ids, purpose and seed; does not depend on partitioning."""
    cols = [F.lit(p) if isinstance(p, int) else (F.lit(p) if isinstance(p, _Text) else col(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """The same number as a double in [0, 1)."""
    return hash_u32(*parts) / F.lit(4294967296.0)


class _Text(str):
    """Marks a string part of a hash as text, not as a column name."""


def text(value: str) -> _Text:
    return _Text(value)
