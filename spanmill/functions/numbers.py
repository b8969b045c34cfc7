"""Rounding and quantiles in double precision, to the last bit as DuckDB computes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """``x`` times a power of ten, rounded half away from zero, and divided again: not the decimal rounding of the digits that ``round`` does."""
    return F.round(x * float(10**places)) / float(10**places)


def _split(x: Column) -> tuple[Column, Column]:
    """Two doubles of 26 bits that add up to ``x``."""
    c = x * 134_217_729.0
    high = c - (c - x)
    return high, x - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` with the product's rounding error added back, as a fused operation gives it."""
    (ah, al), (bh, bl) = _split(a), _split(b)
    p = a * b
    error = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    back = s - p
    return s + (((p - (s - back)) + (c - back)) + error)


def quantile(ordered: Column, q: float) -> Column:
    """The ``q`` quantile of a sorted array without nulls, interpolated; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(float(q))
    low, share = F.floor(at).cast("int"), at - F.floor(at)
    lo, hi = F.get(ordered, low), F.get(ordered, low + 1)
    return F.when(F.size(ordered) > 0, F.when(share == 0, lo).otherwise(fused(lo, 1 - share, hi * share)))
