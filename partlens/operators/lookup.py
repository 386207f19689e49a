"""Values between samples and in bands, and matches that fall back from exact to loose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import text as X


def interpolated(asked: DataFrame, samples: DataFrame, key: list[str], at: str, values: list[str], outside: str = "null") -> DataFrame:
    """Values of each asked place by the samples below and above it (linearly); outside of the samples null, `hold` the end, or an `error`.

    Both sides are ordered together by key and place, so nothing is joined pair by pair.
    """
    marked = lambda rows, real: rows.select(*key, F.col(at).cast("double").alias(at), *(F.col(v).cast("double").alias(v) if real else F.lit(None).cast("double").alias(v) for v in values), F.lit(int(real)).alias("_real"))
    both = marked(samples, True).unionByName(marked(asked.select(*key, at).distinct(), False))
    order = Window.partitionBy(*key).orderBy(at, F.desc("_real"))
    own = F.when(F.col("_real") == 1, F.struct(F.col(at).alias("f"), *values))
    both = both.withColumn("_below", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_above", F.first(own, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    found = both.where("_real = 0")
    lo, hi = F.col("_below"), F.col("_above")
    share = (F.col(at) - lo["f"]) / (hi["f"] - lo["f"])
    beyond = {"null": lambda v: F.lit(None), "hold": lambda v: F.coalesce(lo[v], hi[v]), "error": lambda v: F.raise_error(F.format_string("%s is outside of the samples", F.col(at)))}[outside]
    value = lambda v: F.when(lo["f"] == F.col(at), lo[v]).when(lo.isNull() | hi.isNull(), beyond(v).cast("double")).otherwise(lo[v] + share * (hi[v] - lo[v]))
    return asked.join(found.select(*key, at, *(value(v).alias(v) for v in values)), [*key, at], "left")


def piecewise(asked: DataFrame, bands: DataFrame, at: str, value: str, extrapolate: str = "hold", few: int = 10_000) -> DataFrame:
    """The value of the first ascending band (lo, hi) that holds the place; below all the first, above all the last (`hold`), on the line of the last two ends (`linear`) or an `error`.

    Bands are joined by range; they are broadcast only if they are few.
    """
    ends = bands.agg(F.min_by(value, F.struct("lo", "hi")).alias("_first"), F.min("lo").alias("_least"), F.max_by(value, F.struct("hi", "lo")).alias("_last"), F.max("hi").alias("_most"), F.array_sort(F.collect_list(F.struct("hi", F.col(value).alias("v")))).alias("_ends"))
    small = bands.limit(few + 1).count() <= few
    own = bands.select("lo", "hi", F.col(value).alias("_v"))
    inside = asked.join(F.broadcast(own) if small else own, (F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))).groupBy(at).agg(F.min_by("_v", F.struct("lo", "hi")).alias("_in"))
    rows = asked.join(inside, at, "left").crossJoin(F.broadcast(ends))
    last, before = F.element_at("_ends", -1), F.try_element_at("_ends", F.lit(-2))
    line = F.coalesce(last["v"] + (F.col(at) - last["hi"]) * (last["v"] - before["v"]) / (last["hi"] - before["hi"]), F.col("_last"))
    above = {"hold": F.col("_last"), "linear": line, "error": F.raise_error(F.format_string("%s is above all bands", F.col(at))).cast("double")}[extrapolate]
    # in a gap between bands the next band's value holds
    nxt = F.get(F.filter("_ends", lambda e: e["hi"] >= F.col(at)), F.lit(0))["v"]
    out = F.when(F.col("_in").isNotNull(), F.col("_in")).when(F.col(at) < F.col("_least"), F.col("_first")).when(F.col(at) > F.col("_most"), above).otherwise(nxt)
    return rows.select(*asked.columns, out.alias(value))


def matched(left: DataFrame, right: DataFrame, name: str, levels: list[tuple[str, Column]], pick: str) -> DataFrame:
    """left with `matched` (pick of the right side) and `level`: keys of both sides are made by each level's expression over `name`; the first level that meets counts.

    Of several right rows with the same key the least pick is taken.
    """
    out, found, said = left, [], []
    for i, (level, key) in enumerate(levels):
        own = right.select(key.alias(f"_k{i}"), F.col(pick)).where(f"_k{i} <> ''").groupBy(f"_k{i}").agg(F.min(pick).alias(f"_m{i}"))
        out = out.withColumn(f"_k{i}", key).join(own, f"_k{i}", "left")
        found.append(F.col(f"_m{i}"))
        said.append(F.when(F.col(f"_m{i}").isNotNull(), level))
    return out.select(*left.columns, F.coalesce(*found).alias("matched"), F.coalesce(*said, F.lit("none")).alias("level"))


def distributor_merge(rows: DataFrame, distributor: str, registry: list[str], values: list[str]) -> DataFrame:
    """rows(mpn, vendor, manufacturer, ...): a distributor's row goes when a native vendor lists the part and its manufacturer is that vendor or a known one; what the native row lacks is taken from it."""
    key = X.loose_keep_plus(F.col("mpn"))
    rows = rows.withColumn("_key", key).withColumn("_maker", X.vendor_norm(F.col("manufacturer")))
    far, near = rows.where((F.col("vendor") == distributor) & (F.col("_key") != "")), rows.where(F.col("vendor") != distributor)
    names = near.where("_key <> ''").groupBy("_key").agg(F.collect_set(X.vendor_norm(F.col("vendor"))).alias("_near"))
    known = F.array(*(F.lit("".join(c for c in n.lower() if c.isalnum())) for n in registry)) if registry else F.array().cast("array<string>")
    listed = (F.col("_maker") != "") & F.exists(known, lambda k: F.contains(F.col("_maker"), k) | F.contains(k, F.col("_maker")))
    gone = far.join(names, "_key").where(listed | F.array_contains("_near", F.col("_maker")))
    given = gone.groupBy("_key").agg(*(F.first(v, ignorenulls=True).alias(f"_{v}") for v in values))
    filled = near.join(given, "_key", "left").withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))
    kept = rows.where(F.col("vendor") == distributor).join(gone.select("_key", "_maker").distinct(), ["_key", "_maker"], "left_anti")
    return filled.unionByName(kept, allowMissingColumns=True).drop("_key", "_maker")
