"""Numeric columns: intervals, limits, units and network formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Two-sided Wilson interval; 0 and 0 without trials."""
    p, d = k / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / d)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / d)).otherwise(0.0))


def wilson_upper(k: Column, n: Column, z: float = 1.645) -> Column:
    """One-sided upper bound; 1 without trials."""
    return F.when(n > 0, wilson(k, n, z)[1]).otherwise(1.0)


def cpk(mean: Column, sd: Column, lower: Column, upper: Column) -> Column:
    """The smaller distance to a limit in three deviations; a missing limit is left out."""
    return F.when(sd > 0, F.least((upper - mean) / (3 * sd), (mean - lower) / (3 * sd)))


def margin(x: Column, lower: Column, upper: Column, sd: Column) -> Column:
    """Distance to the nearer limit in half bands, or with one limit in deviations."""
    unit = F.when(sd > 0, sd).otherwise(1.0)
    both = F.least(upper - x, x - lower) / ((upper - lower) / 2)
    return F.when(lower.isNotNull() & upper.isNotNull(), F.when(upper > lower, both)).otherwise(F.coalesce((upper - x) / unit, (x - lower) / unit))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def to_ghz(value: Column, unit: Column) -> Column:
    """Null for units that aren't known."""
    u = F.lower(F.trim(unit))
    return F.when(u == "ghz", value).when(u == "mhz", value / 1e3).when(u == "khz", value / 1e6).when(u == "hz", value / 1e9)


def inferred_ghz(value: Column) -> Column:
    """A bare number's unit by its size: above 1e6 kHz, above 300 MHz, else GHz."""
    return F.when(value > 1e6, value / 1e6).when(value > 300, value / 1e3).otherwise(value)


def watts_to_dbm(w: Column) -> Column:
    return F.when(w > 0, F.bround(10 * F.log10(w * 1000), 1))


def cable_loss_db(f_ghz: Column, feet: Column, fixed: tuple[float, float, float], per_foot: tuple[float, float, float]) -> Column:
    """a0 + a1 f + a2 sqrt(f) for the ends, and the same again for each foot."""
    part = lambda c: c[0] + c[1] * f_ghz + c[2] * F.sqrt(f_ghz)
    return part(fixed) + feet * part(per_foot)


def delay_s(feet: Column, velocity: float) -> Column:
    return feet * 0.3048 / (velocity * 299_792_458.0)


def in_range(value: Column, lo: float | None, hi: float | None) -> Column:
    """A stated value within the bounds that are given; null is outside."""
    test = value.isNotNull()
    if lo is not None:
        test &= value >= lo
    if hi is not None:
        test &= value <= hi
    return test


def band_in_range(lo_edge: Column, hi_edge: Column, lo: float | None, hi: float | None) -> Column:
    """Two bounds: the band covers the window; one bound: it reaches it."""
    if lo is not None and hi is not None:
        return (lo_edge <= lo) & (hi_edge >= hi)
    if lo is not None:
        return hi_edge >= lo
    return lo_edge <= hi if hi is not None else lo_edge.isNotNull()


def parse_filter(text: str) -> tuple[float | None, float | None] | None:
    """`40` and `>30` set the lower bound, `<2` the upper, `=5` both, `4-8` a range, `4-` its lower part; else no filter."""
    import re

    text = text.strip()
    number = r"[+-]?\d+(?:\.\d+)?"
    if m := re.fullmatch(rf"({number})\s*-\s*({number})?", text):
        return tuple(sorted((float(m[1]), float(m[2])))) if m[2] else (float(m[1]), None)
    if m := re.fullmatch(rf"(<=?|>=?|=)?\s*({number})", text):
        value = float(m[2])
        return (None, value) if (m[1] or "").startswith("<") else (value, value) if m[1] == "=" else (value, None)
    return None
