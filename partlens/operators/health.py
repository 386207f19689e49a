"""What the store holds and what it lacks: totals, mixes, coverage, pedigrees, families, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import text as X
from partlens.functions import vocabulary as V

#: Grades from best to none; how they are read from two texts is our definition.
LADDER = ["qualified", "grade", "hi_rel", "none"]
#: Keys every part should state, and keys of radiation.
UNIVERSAL = ["freq_ghz", "package"]
RADIATION = ["tid_krad", "sel_mev"]
#: Keys that say little about performance.
SOFT = ["datasheet_url", "datasheet_file", "package", "lifecycle", "availability", "price_usd", "device_type", "space_evidence", "space_score_pct"]


def coverage_keys(category: str | None) -> list[str]:
    """What a category's parts should state: the universal keys, then its specifications, each once; a band if nothing else."""
    names = [*UNIVERSAL, *V.ASKED.get(category or "", "").split()]
    return list(dict.fromkeys(names)) or ["freq_ghz"]


def spec_counts(specs: DataFrame) -> DataFrame:
    """part_id, n_specs, qualified: inputs of merging."""
    return specs.groupBy("part_id").agg(F.count("*").alias("n_specs"), F.bool_or((F.col("key") == "space_variant") & (F.col("value_text") == "space_qualified")).alias("qualified"))


def pedigrees(parts: DataFrame, specs: DataFrame) -> DataFrame:
    """part_id, pedigree, rank: by the stated variant, else by the general word."""
    said = specs.where(F.col("key").isin("space_variant", "space")).groupBy("part_id").agg(F.max(F.when(F.col("key") == "space_variant", F.col("value_text"))).alias("variant"), F.max(F.when(F.col("key") == "space", F.col("value_text"))).alias("word"))
    grade = F.when((F.col("variant") == "space_qualified") | (F.col("word") == "qualified") & F.col("variant").isNull(), "qualified").when(F.col("variant") == "space_grade", "grade").when(F.col("word") == "hi_rel", "hi_rel").otherwise("none")
    out = parts.select("part_id").join(said, "part_id", "left").withColumn("pedigree", grade)
    return out.select("part_id", "pedigree", (F.array_position(F.array(*map(F.lit, LADDER)), F.col("pedigree")) - 1).alias("rank"))


def pedigree_distribution(parts: DataFrame, specs: DataFrame) -> DataFrame:
    """A row for each grade, also for those that no part has."""
    ladder = parts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LADDER))).alias("pedigree"))
    return ladder.join(pedigrees(parts, specs), "pedigree", "left").groupBy("pedigree").agg(F.count("part_id").alias("n"))


def coverage(parts: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """category, key, covered, parts, percent: how many of a category's parts state a key; one shuffle of the rows that hold one."""
    size = parts.groupBy("category").agg(F.count("*").alias("parts"))
    held = specs.where(F.col("key").isin(keys)).select("part_id", "key").distinct()
    has = parts.select("part_id", "category").join(held, "part_id").groupBy("category", "key").agg(F.count("*").alias("covered"))
    every = size.withColumn("key", F.explode(F.array(*map(F.lit, keys))))
    out = every.join(has, ["category", "key"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("percent", F.bround(100.0 * F.col("covered") / F.col("parts"), 1))


def radiation(parts: DataFrame, specs: DataFrame) -> DataFrame:
    """parts, covered, percent of parts with a radiation key."""
    held = specs.where(F.col("key").isin(RADIATION)).select("part_id").distinct().withColumn("has", F.lit(1))
    out = parts.join(held, "part_id", "left").agg(F.count("*").alias("parts"), F.count("has").alias("covered"))
    return out.withColumn("percent", F.coalesce(F.bround(F.try_divide(100.0 * F.col("covered"), F.col("parts")), 1), F.lit(0.0)))


def families(parts: DataFrame, grades: DataFrame) -> DataFrame:
    """families of more than one part, their members, and how many span several grades."""
    rows = parts.withColumn("family", X.family_key(F.col("mpn"))).join(grades.select("part_id", "pedigree"), "part_id", "left")
    own = rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("pedigree").alias("g")).where("n > 1")
    return own.agg(F.count("*").alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum((F.col("g") > 1).cast("long")), F.lit(0)).alias("spanning"))


def family_of(parts: DataFrame, grades: DataFrame, part_id: int, include_self: bool = True) -> DataFrame:
    """The parts that share a part's family key, best grade first."""
    keyed = parts.withColumn("family", X.family_key(F.col("mpn")))
    own = keyed.where(F.col("part_id") == part_id).select("family").distinct()
    rows = keyed.join(own, "family", "left_semi").join(grades, "part_id", "left")
    return (rows if include_self else rows.where(F.col("part_id") != part_id)).orderBy("rank", "mpn")


def by_number(parts: DataFrame, mpn: str) -> DataFrame:
    """A part by its number: exactly, else in any case, else loosely; only the best level's rows."""
    level = F.when(F.col("mpn") == mpn, 0).when(F.lower("mpn") == mpn.lower(), 1).when(X.loose_keep_plus(F.col("mpn")) == "".join(c for c in mpn.upper() if c.isalnum() and c.isascii() or c == "+"), 2)
    rows = parts.withColumn("level", level).where("level IS NOT NULL")
    return rows.withColumn("_best", F.min("level").over(Window.partitionBy(F.lit(1)))).where("level = _best").drop("_best")


def source_overlap(evidence: DataFrame, parts: DataFrame, a: str, b: str) -> DataFrame:
    """both_sources, only_a, only_b, other: parts by the sources that list them."""
    has = lambda p: F.coalesce(F.bool_or(F.col("signal").ilike(p)), F.lit(False))
    flags = parts.join(evidence.select("part_id", "signal").distinct(), "part_id", "left").groupBy("part_id").agg(has(a).alias("a"), has(b).alias("b"))
    one = F.col("a"), F.col("b")
    return flags.agg(F.count_if(one[0] & one[1]).alias("both_sources"), F.count_if(one[0] & ~one[1]).alias("only_a"), F.count_if(one[1] & ~one[0]).alias("only_b"), F.count_if(~one[0] & ~one[1]).alias("other"))


def snapshot(parts: DataFrame, specs: DataFrame, evidence: DataFrame, vendor: str | None = None, sources: tuple[str, str] = ("%satnow%", "%erf%")) -> dict[str, DataFrame]:
    """All figures of the store, or of one vendor by a loose match of its name."""
    if vendor:
        parts = parts.where(X.vendor_matches(F.col("vendor"), F.lit(vendor)))
        specs, evidence = (rows.join(parts.select("part_id"), "part_id", "left_semi") for rows in (specs, evidence))
    grades = pedigrees(parts, specs)
    loose = parts.groupBy(X.loose_keep_plus(F.col("mpn")).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    keys = sorted({k for c in [None, *V.ASKED] for k in coverage_keys(c)})
    return {
        "categories": parts.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"), "pedigrees": pedigree_distribution(parts, specs), "coverage": coverage(parts, specs, keys),
        "radiation": radiation(parts, specs), "overlap": source_overlap(evidence, parts, *sources), "duplicates": loose.agg(F.count("*").alias("groups")), "families": families(parts, grades),
    }


def reasons(specs: DataFrame, evidence: DataFrame, parts: DataFrame) -> DataFrame:
    """part_id, reason: why a part counts as space qualified: the stated value, the variant, then the evidence; others are left out."""
    said = specs.where(F.col("key").isin("space", "space_variant")).groupBy("part_id").agg(F.min_by("value_text", F.when(F.col("key") == "space", F.struct("source_url", "seq"))).alias("space"), F.min_by("value_text", F.when(F.col("key") == "space_variant", F.struct("source_url", "seq"))).alias("variant"))
    signals = evidence.groupBy("part_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    listed = F.get(F.filter("signals", lambda s: F.contains(F.lower(s), F.lit("space"))), F.lit(0))
    reason = F.when(F.col("space") == "qualified", "space=qualified").when(F.coalesce("variant", F.lit("")).startswith("space"), F.concat(F.lit("variant="), "variant")).when(listed.isNotNull(), F.concat(F.lit("evidence="), listed))
    out = parts.select("part_id").join(said, "part_id", "left").join(signals, "part_id", "left").withColumn("reason", reason)
    return out.where("reason IS NOT NULL").select("part_id", "reason")


def by_reason(found: DataFrame, parts: DataFrame) -> DataFrame:
    """vendor, reason, n and the first part of each."""
    return found.join(parts.select("part_id", "vendor", "mpn"), "part_id").groupBy("vendor", "reason").agg(F.count("*").alias("n"), F.min("mpn").alias("example"))


def described(tables: dict[str, DataFrame], top: int = 5) -> DataFrame:
    """table, rows of several tables, to compare stores."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out


def hard_count(keys: Column) -> Column:
    """How many of an array of keys say something about performance."""
    return F.size(F.filter(F.array_distinct(keys), lambda k: ~k.isin(SOFT)))


def best_values(specs: DataFrame) -> DataFrame:
    """part_id, key, value: stored values by confidence, rows mined from datasheets left out; a band as its two edges."""
    rows = specs.where("method <> 'datasheet'")
    pair = F.when(F.col("key") == "freq_ghz", F.array(F.struct(F.lit("freq_min").alias("key"), F.col("value_min").alias("value")), F.struct(F.lit("freq_max").alias("key"), F.col("value_max").alias("value")))).otherwise(F.array(F.struct("key", F.coalesce("value_typ", "value_max", "value_min").alias("value"))))
    rows = rows.select("part_id", "confidence", "seq", F.explode(pair).alias("p")).where("p.value IS NOT NULL")
    return rows.groupBy("part_id", F.col("p.key").alias("key")).agg(F.max_by("p.value", F.struct("confidence", -F.col("seq"))).alias("value"))


def verdict(kind: Column, chars: Column, n_specs: Column, hard: Column, conflicts: Column) -> Column:
    """What a datasheet is worth: corrupt, thin, without specs, in conflict with the store, few specs, fine."""
    return F.when(kind == "corrupt", "CORRUPT").when(chars < 200, "THIN").when(n_specs == 0, "NO-SPECS").when(conflicts > 0, "CONFLICT").when(hard < 3, "FEW-SPECS").otherwise("OK")


def sane_band(lo: Column, hi: Column, said_lo: Column, said_hi: Column) -> Column:
    """struct(inverted, wide, disagrees): checks of a stored band against itself and a described one (5 % or 0.05 GHz)."""
    off = lambda a, b: F.abs(a - b) > F.greatest(F.lit(0.05), 0.05 * F.greatest(F.abs(a), F.abs(b)))
    return F.struct((lo > hi).alias("inverted"), (hi > 300).alias("wide"), F.coalesce(off(lo, said_lo) | off(hi, said_hi), F.lit(False)).alias("disagrees"))
