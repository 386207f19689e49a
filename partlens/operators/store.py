"""Store operations as set-based rewrites: upserts, merges, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-replace: the last row of each key in order."""
    at = Window.partitionBy(*key).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First occurrence wins."""
    at = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def upsert_text(rows: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """Non-empty text overwrites, empty text never does."""
    kept = [F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order))), F.lit("")).alias(c) for c in columns]
    return rows.groupBy(*key).agg(*kept)


def winners(rows: DataFrame, group: Column, order: list[Column], name: str | None = None) -> DataFrame:
    """In groups of more than one: place 1 wins, the others lose; with a name, the winner's value of that column stands on every row as `winner`."""
    at = Window.partitionBy("_group").orderBy(*order)
    all_of = Window.partitionBy("_group")
    out = rows.withColumn("_group", group).withColumn("place", F.row_number().over(at)).withColumn("_n", F.count("*").over(all_of))
    out = out.withColumn("winner", F.first(name).over(at)) if name else out
    return out.where("_n > 1").drop("_n")


def round_robin(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """turn: the row's place among those of its source; sorting by (turn, source) interleaves the sources."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def pop(frontier: DataFrame, domain: str, priority: str, budget: int, tie: str) -> DataFrame:
    """The highest priorities within each domain's budget."""
    at = Window.partitionBy(domain).orderBy(F.col(priority).desc(), F.col(tie))
    return frontier.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= budget).drop("_n")


def done(rows: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Resume: what the log hasn't completed."""
    return rows.join(log.select(*key).distinct(), key, "left_anti")


def merged_facts(old: Column, new: Column) -> Column:
    """Facts of a vendor as a map: new values win, others stay."""
    old, new = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def counted_templates(hits: DataFrame) -> DataFrame:
    """domain, n_segments, prefix with the sum of their hits."""
    return hits.groupBy("domain", "n_segments", "prefix").agg(F.sum("hits").alias("hits"), F.max("updated_at").alias("updated_at"))


def overlaid(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; what the overlay states wins, column by column."""
    columns = [c for c in dict.fromkeys([*base.columns, *overlay.columns]) if c != key]
    a = base.select(key, *(F.col(c).alias(f"_a_{c}") for c in base.columns if c != key))
    b = overlay.select(key, *(F.col(c).alias(f"_b_{c}") for c in overlay.columns if c != key))
    side = lambda c: [F.col(f"_{x}_{c}") for x, own in (("b", overlay), ("a", base)) if c in own.columns]
    return a.join(b, key, "full").select(key, *(F.coalesce(*side(c)).alias(c) for c in columns))


def first_of(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several sources in order of their rank: those of a later source only where an earlier one has no row of the key."""
    out = None
    for i, rows in enumerate(sources):
        own = rows.withColumn("_rank", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    best = Window.partitionBy(*key)
    return out.withColumn("_best", F.min("_rank").over(best)).where("_rank = _best").drop("_rank", "_best")


def vendor_names(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """vendor: names of the registry and the store, folded on letters and digits; the registry's spelling wins."""
    from partlens.functions.text import vendor_norm

    rows = first_of([registry.select("vendor").where("trim(vendor) <> ''").withColumn("k", vendor_norm(F.col("vendor"))), stored.select("vendor").where("trim(vendor) <> ''").withColumn("k", vendor_norm(F.col("vendor")))], ["k"])
    return rows.groupBy("k").agg(F.min("vendor").alias("vendor")).select("vendor").orderBy(F.lower("vendor"))


def link_lists(targets: list[DataFrame], key: list[str]) -> DataFrame:
    """key, urls: addresses of several sources in the order of their rank, each once; space is the highest stated."""
    out = None
    for i, rows in enumerate(targets):
        own = rows.withColumn("_rank", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "seq", "url"))), lambda x: x["url"]))
    return out.groupBy(*key).agg(listed.alias("urls"), F.max(F.when(F.col("space") == "space_qualified", 2).when(F.col("space") == "space_grade", 1).otherwise(0)).alias("space"))


def reset(parts: DataFrame, children: dict[str, DataFrame], vendors: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The store without the vendors' parts (all, if none are named) and without rows that belong to them."""
    from partlens.functions.text import vendor_matches

    gone = F.lit(vendors is None)
    for v in vendors or []:
        gone |= vendor_matches(F.col("vendor"), F.lit(v))
    kept = parts.where(~gone)
    return kept, {name: rows.join(kept.select("part_id"), "part_id", "left_semi") for name, rows in children.items()}


def sampled(rows: DataFrame, cell: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each cell by a seeded hash: the same ones in every run."""
    at = Window.partitionBy(*cell).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= n).drop("_n")


def last_by(rows: DataFrame, column: Column, descending: bool = False) -> list[Column]:
    """An order by a column in which missing values come last either way."""
    return [column.desc_nulls_last() if descending else column.asc_nulls_last()]
