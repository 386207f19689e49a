"""From stored rows to resolved records: arbitration, bands, fallbacks, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_confidence(specs: DataFrame, keys: list[str], value: str, confidence: str, order: list[str]) -> DataFrame:
    """The value of the highest confidence; of equal ones the last in order."""
    best = F.max_by(F.col(value), F.struct(F.col(confidence), *map(F.col, order)))
    return specs.groupBy(*keys).agg(best.alias(value))


def wide_by_order(rows: DataFrame, keys: list[str], values: dict[str, str], order: list[Column]) -> DataFrame:
    """For each value its last one in order (of equal places the greatest), as a column: rows that hold several values are grouped as they are, not taken apart first."""
    return rows.groupBy(*keys).agg(*(F.max_by(v, F.struct(*order, v)).alias(name) for name, v in values.items()))


def as_rows(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, key, value: the columns named as rows, missing values left out."""
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names)), lambda p: p["value"].isNotNull())
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.key", "p.value")


def pick(preference: str, low: Column, typical: Column, high: Column) -> Column:
    """The guaranteed edge first: min, typ, max for `min`; max, typ, min for `max`; typ, max, min for `typ`."""
    order = {"min": (low, typical, high), "max": (high, typical, low), "typ": (typical, high, low)}
    return F.coalesce(*order[preference])


def fold_band(rows: DataFrame, keys: list[str], edge: Column) -> DataFrame:
    """lo and hi where there are two different edges, else null (a one-sided band is no band)."""
    lo, hi = F.min(edge), F.max(edge)
    return rows.groupBy(*keys).agg(F.when(lo < hi, lo).alias("lo"), F.when(lo < hi, hi).alias("hi"))


def best_band(bands: DataFrame, key: str, lo: float, hi: float, preference: str = "max") -> DataFrame:
    """Of several banded values the one that covers the wanted band, or overlaps it most; no overlap, no value."""
    overlap = F.least(F.col("hi"), F.lit(hi)) - F.greatest(F.col("lo"), F.lit(lo))
    covers = ((F.col("lo") <= lo) & (F.col("hi") >= hi)).cast("int")
    ranked = bands.withColumn("_o", overlap).where("_o > 0").withColumn("_c", covers)
    tie = F.col("value") if preference == "max" else -F.col("value")
    return ranked.groupBy(key).agg(F.max_by("value", F.struct("_c", "_o", tie)).alias("value"))


def worst_band(bands: DataFrame, key: str, preference: str = "max") -> DataFrame:
    """Without a wanted band: the value that holds everywhere."""
    return bands.groupBy(key).agg((F.max("value") if preference == "max" else F.min("value")).alias("value"))


def criteria(states: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Numbers of met, missed and unknown criteria; a state column is true, false or null."""
    count = lambda test: reduce(lambda a, b: a + b, [F.when(test(s), 1).otherwise(0) for s in states.values()])
    return count(lambda s: F.coalesce(s, F.lit(False))), count(lambda s: ~F.coalesce(s, F.lit(True))), count(lambda s: s.isNull())


def fit(met: Column, unknown: Column, total: int, space: Column | float = 0.0) -> Column:
    """Met counts 100, unknown 45, missed 0; rounded half to even, within 0..100."""
    extra = F.lit(space) if isinstance(space, float) else space
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.lit(0.94) * (100 * met + 45 * unknown) / total + extra).cast("int")))


def tier(missed: Column, unknown: Column) -> Column:
    return F.when(missed > 0, "C").when(unknown > 0, "B").otherwise("A")
