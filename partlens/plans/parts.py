"""Part store and search over the dataset's stand-ins: parts are `part`, specifications are the values of `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import text as X
from partlens.operators import filters as L
from partlens.operators import resolve as R
from partlens.operators import store as S

from .registry import query, r6

SPECS = """specs AS (SELECT l_partkey AS part_id, key, value, l_suppkey AS source, 1 - l_discount AS confidence, l_orderkey AS s1, l_linenumber AS s2 FROM lineitem,
 LATERAL (VALUES ('qty', l_quantity), ('price', l_extendedprice), ('disc', l_discount), ('tax', l_tax)) v(key, value))"""
RESOLVED = SPECS + """, resolved AS (SELECT part_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY part_id, key
 ORDER BY confidence DESC, s1 DESC, s2 DESC, source DESC, value DESC) AS n FROM specs) WHERE n = 1)"""


def specs(t):
    """lineitem as long rows: one for each key."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"), ("tax", "l_tax"))))
    rows = t("lineitem").select(F.col("l_partkey").alias("part_id"), F.explode(pairs).alias("s"), F.col("l_suppkey").alias("source"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("s1"), F.col("l_linenumber").alias("s2"))
    return rows.select("part_id", "s.key", "s.value", "source", "confidence", "s1", "s2")


VALUES = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}


def resolved(t):
    """One row for each part: the value of the highest confidence for each key, of equal ones the last."""
    order = [(1 - F.col("l_discount")).alias("c"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return R.wide_by_order(t("lineitem").withColumnRenamed("l_partkey", "part_id"), ["part_id"], VALUES, order)


@query(f"WITH {RESOLVED} SELECT part_id, key, value FROM resolved")
def resolve_confidence(t):
    return R.as_rows(resolved(t), ["part_id"], list(VALUES))


PICK = "min(CASE WHEN l_discount > 0 THEN l_discount END) AS a, avg(CASE WHEN l_tax > 0.04 THEN l_tax END) AS b, max(CASE WHEN l_quantity > 45 THEN l_quantity END) AS c"


@query(f"SELECT part_id, round(coalesce(a, b, c), 6) AS pick_min, round(coalesce(c, b, a), 6) AS pick_max, round(coalesce(b, c, a), 6) AS pick_typ FROM (SELECT l_partkey AS part_id, {PICK} FROM lineitem GROUP BY 1)")
def pick_guarantee_first(t):
    rows = t("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(
        F.min(F.when(F.col("l_discount") > 0, F.col("l_discount"))).alias("a"), F.avg(F.when(F.col("l_tax") > 0.04, F.col("l_tax"))).alias("b"), F.max(F.when(F.col("l_quantity") > 45, F.col("l_quantity"))).alias("c")
    )
    return rows.select("part_id", *(r6(R.pick(p, F.col("a"), F.col("b"), F.col("c")), f"pick_{p}") for p in ("min", "max", "typ")))


@query("SELECT part_id, CASE WHEN lo < hi THEN lo END AS lo, CASE WHEN lo < hi THEN hi END AS hi FROM (SELECT l_partkey AS part_id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)")
def band_fold(t):
    return R.fold_band(t("lineitem").withColumnRenamed("l_partkey", "part_id"), ["part_id"], F.col("l_quantity"))


BANDS = "bands AS (SELECT l_partkey AS part_id, l_linestatus AS g, min(l_quantity) AS lo, max(l_quantity) AS hi, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def bands(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("part_id"), F.col("l_linestatus").alias("g")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.max("l_extendedprice").alias("value"))


@query(f"""WITH {BANDS} SELECT part_id, value FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY (CASE WHEN lo <= 10 AND hi >= 40 THEN 1 ELSE 0 END) DESC,
 least(hi, 40) - greatest(lo, 10) DESC, value DESC) AS n FROM bands WHERE least(hi, 40) - greatest(lo, 10) > 0) WHERE n = 1""")
def banded_best_overlap(t):
    return R.best_band(bands(t), "part_id", 10.0, 40.0)


@query(f"WITH {BANDS} SELECT part_id, max(value) AS value FROM bands GROUP BY 1")
def banded_worst_case(t):
    return R.worst_band(bands(t), "part_id")


@query("""SELECT part_id, coalesce(nf, abs(il), abs(cl)) AS nf_db, CASE WHEN nf IS NOT NULL THEN 'nf' WHEN il IS NOT NULL THEN 'insertion_loss' WHEN cl IS NOT NULL THEN 'conversion_loss' END AS nf_from
 FROM (SELECT l_partkey AS part_id, max(CASE WHEN l_returnflag = 'A' THEN l_tax END) AS nf, -max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS il, -max(CASE WHEN l_returnflag = 'N' AND l_quantity > 25 THEN l_quantity END) AS cl FROM lineitem GROUP BY 1)""")
def nf_fallback(t):
    flag = lambda f, c, more=True: F.max(F.when((F.col("l_returnflag") == f) & F.lit(True) & more, F.col(c)))
    rows = t("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(flag("A", "l_tax").alias("nf"), (-flag("R", "l_discount")).alias("il"), (-flag("N", "l_quantity", F.col("l_quantity") > 25)).alias("cl"))
    source = F.when(F.col("nf").isNotNull(), "nf").when(F.col("il").isNotNull(), "insertion_loss").when(F.col("cl").isNotNull(), "conversion_loss")
    return rows.select("part_id", F.coalesce("nf", F.abs("il"), F.abs("cl")).alias("nf_db"), source.alias("nf_from"))


SCORED = RESOLVED + """, wide AS (SELECT part_id, max(CASE WHEN key = 'price' THEN value END) AS price, max(CASE WHEN key = 'disc' THEN value END) AS disc FROM resolved GROUP BY 1),
 banded AS (SELECT l_partkey AS part_id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1 HAVING min(l_quantity) < max(l_quantity)),
 states AS (SELECT p_partkey AS part_id, price, (lo <= 10 AND hi >= 40) AS s1, price >= 30000 AS s2, disc <= 0.05 AS s3 FROM part LEFT JOIN wide ON p_partkey = wide.part_id LEFT JOIN banded ON p_partkey = banded.part_id),
 counted AS (SELECT *, (CASE WHEN s1 THEN 1 ELSE 0 END) + (CASE WHEN s2 THEN 1 ELSE 0 END) + (CASE WHEN s3 THEN 1 ELSE 0 END) AS met,
 (CASE WHEN s1 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN s2 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN s3 IS NULL THEN 1 ELSE 0 END) AS unknown FROM states),
 scored AS (SELECT part_id, price, met, 3 - met - unknown AS missed, unknown, CAST(round_even(0.94 * (100 * met + 45 * unknown) / 3, 0) AS INTEGER) AS fit,
 CASE WHEN 3 - met - unknown > 0 THEN 'C' WHEN unknown > 0 THEN 'B' ELSE 'A' END AS tier FROM counted)"""


def scored(t):
    """Parts with three criteria: the band covers 10..40, price at least 30 000, discount at most 0.05. One pass over the rows gives values and band."""
    rows = t("lineitem").withColumnRenamed("l_partkey", "part_id")
    order = [(1 - F.col("l_discount")).alias("c"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    last = lambda v: F.max_by(v, F.struct(*order, v))
    lo, hi = F.min("l_quantity"), F.max("l_quantity")
    wide = rows.groupBy("part_id").agg(last(VALUES["price"]).alias("price"), last(VALUES["disc"]).alias("disc"), F.when(lo < hi, lo).alias("lo"), F.when(lo < hi, hi).alias("hi"))
    rows = t("part").select(F.col("p_partkey").alias("part_id")).join(wide, "part_id", "left")
    met, missed, unknown = R.criteria({"band": (F.col("lo") <= 10) & (F.col("hi") >= 40), "price": F.col("price") >= 30000, "disc": F.col("disc") <= 0.05})
    rows = rows.select("part_id", "price", met.alias("met"), missed.alias("missed"), unknown.alias("unknown"))
    return rows.withColumn("fit", R.fit(F.col("met"), F.col("unknown"), 3)).withColumn("tier", R.tier(F.col("missed"), F.col("unknown")))


@query(f"WITH {SCORED} SELECT part_id, tier, fit, met, missed, unknown, price FROM scored ORDER BY tier, fit DESC, unknown, met DESC, price NULLS LAST, part_id LIMIT 20")
def search_rank(t):
    order = ["tier", F.desc("fit"), "unknown", F.desc("met"), F.asc_nulls_last("price"), "part_id"]
    return scored(t).orderBy(*order).limit(20).select("part_id", "tier", "fit", "met", "missed", "unknown", "price")


@query(f"WITH {SCORED} SELECT tier, count(*) AS n FROM scored GROUP BY 1")
def tier_counts(t):
    return scored(t).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS part_id, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_retailprice >= 900")
def spec_filter_range(t):
    size, price = N.parse_filter("40-10"), N.parse_filter(">900")
    return t("part").where(N.in_range(F.col("p_size"), *size) & N.in_range(F.col("p_retailprice"), *price)).select(F.col("p_partkey").alias("part_id"), "p_size", "p_retailprice")


@query(f"WITH {BANDS} SELECT part_id, g, lo, hi FROM bands WHERE lo <= 5 AND hi >= 30")
def band_filter_window(t):
    return bands(t).where(N.band_in_range(F.col("lo"), F.col("hi"), 5, 30)).select("part_id", "g", "lo", "hi")


@query("SELECT p_partkey AS part_id, p_type FROM part WHERE p_type LIKE '%STEEL%' OR NOT (p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%')")
def sibling_filter(t):
    return t("part").where(L.sibling_keep(F.col("p_type"), F.lit(None).cast("string"), ["steel"], ["brass", "copper"])).select(F.col("p_partkey").alias("part_id"), "p_type")


@query("SELECT coalesce(nullif(trim(p_brand), ''), '(unknown)') AS vendor, count(*) AS n FROM part GROUP BY 1")
def vendor_counts(t):
    return t("part").groupBy(X.folded(F.col("p_brand")).alias("vendor")).agg(F.count("*").alias("n"))


@query("SELECT CASE lower(regexp_replace(p_brand, '[^a-zA-Z0-9 ]', ' ', 'g')) WHEN 'brand 11' THEN 'Brand#1' WHEN 'brand 12' THEN 'Brand#1' ELSE p_brand END AS vendor, count(*) AS n FROM part GROUP BY 1")
def canonical_vendor_facet(t):
    name = X.canonical(F.col("p_brand"), {"brand 11": "Brand#1", "brand 12": "Brand#1"}, ("inc", "ltd", "gmbh", "corp", "llc"))
    return t("part").groupBy(name.alias("vendor")).agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT p_partkey) AS parts, count(DISTINCT CASE WHEN p_size >= 40 THEN p_partkey END) AS qualified, count(DISTINCT CASE WHEN p_size BETWEEN 20 AND 39 THEN p_partkey END) AS grade,
 count(DISTINCT nullif(trim(p_brand), '')) AS vendors FROM part""")
def dataset_stats(t):
    part = F.col("p_partkey")
    return t("part").agg(
        F.count_distinct(part).alias("parts"), F.count_distinct(F.when(F.col("p_size") >= 40, part)).alias("qualified"),
        F.count_distinct(F.when(F.col("p_size").between(20, 39), part)).alias("grade"), F.count_distinct(F.nullif(F.trim("p_brand"), F.lit(""))).alias("vendors"),
    )


@query("""SELECT p_type AS category, count(DISTINCT CASE WHEN l_tax > 0.05 THEN p_partkey END) AS covered, count(DISTINCT p_partkey) AS parts,
 round_even(100.0 * count(DISTINCT CASE WHEN l_tax > 0.05 THEN p_partkey END) / count(DISTINCT p_partkey), 1) AS percent FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def category_coverage(t):
    flags = t("lineitem").groupBy("l_partkey").agg(F.max((F.col("l_tax") > 0.05).cast("int")).alias("has"))
    rows = t("part").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(F.col("p_type").alias("category"))
    out = rows.agg(F.sum(F.coalesce("has", F.lit(0))).alias("covered"), F.count("*").alias("parts"))
    return out.withColumn("percent", F.bround(100.0 * F.col("covered") / F.col("parts"), 1))


@query("""SELECT count(*) FILTER (WHERE a AND r) AS both_sources, count(*) FILTER (WHERE a AND NOT r) AS only_a, count(*) FILTER (WHERE r AND NOT a) AS only_r, count(*) FILTER (WHERE NOT a AND NOT r) AS other
 FROM (SELECT p_partkey, coalesce(bool_or(l_returnflag = 'A'), false) AS a, coalesce(bool_or(l_returnflag = 'R'), false) AS r FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)""")
def source_overlap(t):
    has = lambda f: F.coalesce(F.bool_or(F.col("l_returnflag") == f), F.lit(False))
    flags = t("part").join(t("lineitem").select("l_partkey", "l_returnflag").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_partkey").agg(has("A").alias("a"), has("R").alias("r"))
    a, r = F.col("a"), F.col("r")
    return flags.agg(*(F.sum(x.cast("long")).alias(n) for n, x in (("both_sources", a & r), ("only_a", a & ~r), ("only_r", r & ~a), ("other", ~a & ~r))))


LADDER = "CASE WHEN p_size >= 40 THEN 'qualified' WHEN p_size >= 20 THEN 'grade' WHEN p_size >= 10 THEN 'hi_rel' ELSE 'none' END"


@query(f"SELECT l AS pedigree, count(p_partkey) AS n FROM (VALUES ('qualified'), ('grade'), ('hi_rel'), ('none'), ('unused')) v(l) LEFT JOIN (SELECT p_partkey, {LADDER} AS g FROM part) ON g = l GROUP BY 1")
def pedigree_distribution(t):
    parts = t("part").select("p_partkey", F.expr(LADDER).alias("pedigree"))
    ladder = F.explode(F.array(*map(F.lit, ("qualified", "grade", "hi_rel", "none", "unused")))).alias("pedigree")
    return parts.sparkSession.range(1).select(ladder).join(parts, "pedigree", "left").groupBy("pedigree").agg(F.count("p_partkey").alias("n"))


FAMILY = "split_part(p_name, ' ', 1)"


@query(f"""SELECT count(*) AS families, CAST(sum(n) AS BIGINT) AS members, CAST(sum(CASE WHEN g > 1 THEN 1 ELSE 0 END) AS BIGINT) AS spanning FROM
 (SELECT {FAMILY} AS f, count(*) AS n, count(DISTINCT {LADDER}) AS g FROM part GROUP BY 1 HAVING count(*) > 1)""")
def family_stats(t):
    rows = t("part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("f")).agg(F.count("*").alias("n"), F.count_distinct(F.expr(LADDER)).alias("g")).where("n > 1")
    return rows.agg(F.count("*").alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum((F.col("g") > 1).cast("long")), F.lit(0)).alias("spanning"))


LOOSE = "regexp_replace(upper(p_name), '[^A-Z0-9+]', '', 'g')"


@query(f"SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM (SELECT {LOOSE} AS k, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)")
def duplicate_groups(t):
    rows = t("part").groupBy(X.loose_keep_plus(F.col("p_name")).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


RANKED = """ranked AS (SELECT p_partkey AS part_id, k, row_number() OVER (PARTITION BY k ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) AS place, count(*) OVER (PARTITION BY k) AS n
 FROM (SELECT *, split_part(p_name, ' ', 1) || p_brand AS k FROM part))"""


def ranked(t):
    group = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_brand"))
    return S.winners(t("part"), group, [F.desc("p_size"), F.desc("p_retailprice"), F.desc("p_partkey")])


@query(f"WITH {RANKED} SELECT k, part_id AS winner, n AS members FROM ranked WHERE n > 1 AND place = 1")
def merge_duplicates_winners(t):
    return ranked(t).groupBy(F.col("_group").alias("k")).agg(F.max(F.when(F.col("place") == 1, F.col("p_partkey"))).alias("winner"), F.count("*").alias("members"))


@query(f"""WITH {RANKED}, {SPECS}, owned AS (SELECT w.part_id AS winner, key, source, value, r.place, s1, s2 FROM ranked r JOIN ranked w ON r.k = w.k AND w.place = 1 AND w.n > 1 JOIN specs ON specs.part_id = r.part_id)
 SELECT winner, key, source, value FROM (SELECT *, row_number() OVER (PARTITION BY winner, key, source ORDER BY place, s1 DESC, s2 DESC, value DESC) AS x FROM owned) WHERE x = 1""")
def merge_duplicates_specs(t):
    """The winner's rows first, then the losers' in their order; of one part's rows the last."""
    group = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_brand"))
    places = S.winners(t("part"), group, [F.desc("p_size"), F.desc("p_retailprice"), F.desc("p_partkey")], "p_partkey").select(F.col("p_partkey").alias("l_partkey"), "winner", "place")
    moved = t("lineitem").join(places, "l_partkey").withColumnRenamed("l_suppkey", "source")
    wide = R.wide_by_order(moved, ["winner", "source"], VALUES, [(-F.col("place")).alias("p"), F.col("l_orderkey"), F.col("l_linenumber")])
    return R.as_rows(wide, ["winner", "source"], list(VALUES)).select("winner", "key", "source", "value")


@query("SELECT user_id % 7 AS vendor, event_type AS kind, CAST(value > 50 AS BOOLEAN) AS done, count(*) AS n, round(sum(value), 6) AS parts FROM events GROUP BY 1, 2, 3")
def scrape_summary(t):
    return t("events").groupBy((F.col("user_id") % 7).alias("vendor"), F.col("event_type").alias("kind"), (F.col("value") > 50).alias("done")).agg(F.count("*").alias("n"), r6(F.sum("value"), "parts"))


@query(f"""WITH {SPECS} SELECT p_brand AS vendor, count(DISTINCT CASE WHEN key = 'qty' AND value > 30 THEN part_id END) AS qty, count(DISTINCT CASE WHEN key = 'tax' AND value > 0.05 THEN part_id END) AS tax
 FROM specs JOIN part ON p_partkey = part_id GROUP BY 1""")
def coverage_pivot(t):
    held = specs(t).where("(key = 'qty' AND value > 30) OR (key = 'tax' AND value > 0.05)").select("part_id", "key").distinct()
    out = t("part").select(F.col("p_brand").alias("vendor"), F.col("p_partkey").alias("part_id")).join(held, "part_id").groupBy("vendor").pivot("key", ["qty", "tax"]).agg(F.count("part_id"))
    return out.select("vendor", F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("tax", F.lit(0)).alias("tax"))


@query("""SELECT p_brand AS vendor, p_size % 5 AS category, round(avg(p_retailprice), 6) AS mean, count(*) FILTER (WHERE p_retailprice < 1000) AS bad, count(*) AS n FROM part GROUP BY 1, 2""")
def vendor_category_matrix(t):
    return t("part").groupBy(F.col("p_brand").alias("vendor"), (F.col("p_size") % 5).alias("category")).agg(r6(F.avg("p_retailprice"), "mean"), F.sum((F.col("p_retailprice") < 1000).cast("long")).alias("bad"), F.count("*").alias("n"))


@query("SELECT p_partkey AS part_id, p_name, p_brand FROM part WHERE p_name ILIKE '%al%' AND contains(lower(p_brand), 'brand') ORDER BY lower(p_brand), lower(p_name), p_partkey LIMIT 50")
def inspect_list(t):
    rows = t("part").where(F.col("p_name").ilike("%al%") & F.contains(F.lower("p_brand"), F.lit("brand")))
    return rows.orderBy(F.lower("p_brand"), F.lower("p_name"), "p_partkey").limit(50).select(F.col("p_partkey").alias("part_id"), "p_name", "p_brand")


@query("SELECT p_type AS category, count(*) AS n, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') THEN p_partkey END) AS tagged FROM part GROUP BY 1")
def inspect_categories(t):
    tagged = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("tag", F.lit(1))
    return t("part").join(tagged, "p_partkey", "left").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.count("tag").alias("tagged"))


@query("SELECT p_partkey AS part_id, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 40)")
def semi_space_parts(t):
    hits = t("lineitem").where("l_returnflag = 'A' AND l_quantity > 40")
    return t("part").join(hits, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_partkey").alias("part_id"), "p_brand")


@query("""SELECT p_partkey AS part_id, s.first_source, s.signals FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS first_source, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS signals FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""")
def scalar_subquery_reason(t):
    evidence = t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_source"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("signals"))
    return t("part").join(evidence, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("part_id"), "first_source", "signals")


@query("""WITH a AS (SELECT p_partkey AS part_id, p_name FROM part), x AS (SELECT p_name, min(p_partkey) AS m FROM part WHERE p_size > 25 GROUP BY 1), y AS (SELECT split_part(p_name, ' ', 1) AS w, min(p_partkey) AS m FROM part WHERE p_size > 45 GROUP BY 1)
 SELECT a.part_id, coalesce(x.m, y.m, -1) AS matched, CASE WHEN x.m IS NOT NULL THEN 'exact' WHEN y.m IS NOT NULL THEN 'loose' ELSE 'none' END AS level FROM a LEFT JOIN x USING (p_name) LEFT JOIN y ON split_part(a.p_name, ' ', 1) = y.w""")
def match_cascade(t):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    exact = t("part").where("p_size > 25").groupBy("p_name").agg(F.min("p_partkey").alias("m1"))
    loosely = t("part").where("p_size > 45").groupBy(word.alias("w")).agg(F.min("p_partkey").alias("m2"))
    rows = t("part").select(F.col("p_partkey").alias("part_id"), "p_name", word.alias("w")).join(exact, "p_name", "left").join(loosely, "w", "left")
    return rows.select("part_id", F.coalesce("m1", "m2", F.lit(-1)).alias("matched"), F.when(F.col("m1").isNotNull(), "exact").when(F.col("m2").isNotNull(), "loose").otherwise("none").alias("level"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_anti(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NULL THEN 'db' ELSE 'pages' END AS source, (a.v IS NOT NULL AND b.v IS NOT NULL) AS overlap FROM (SELECT l_partkey AS k, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
 FULL JOIN (SELECT l_partkey AS k, max(l_discount) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (k)""")
def oracle_priority_union(t):
    side = lambda flag, c, name: t("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.max(c).alias(name))
    rows = side("A", "l_tax", "a").join(side("R", "l_discount", "b"), "k", "full")
    return rows.select("k", F.coalesce("a", "b").alias("v"), F.when(F.col("a").isNull(), "db").otherwise("pages").alias("source"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"))


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, s_acctbal) AS balance, s_suppkey IS NOT NULL AS merged FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey AND c_nationkey % 5 = s_nationkey % 5""")
def distributor_fill(t):
    match = (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") % 5 == F.col("s_nationkey") % 5)
    rows = t("customer").join(t("supplier"), match, "left")
    return rows.select(F.col("c_custkey").alias("id"), F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "s_acctbal").alias("balance"), F.col("s_suppkey").isNotNull().alias("merged"))


@query("""SELECT DISTINCT a.p_partkey AS part_id, 'space_variant' AS key, 'space_qualified' AS text, 8.0 AS weight FROM part a JOIN part b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) WHERE b.p_brand = 'Brand#11' AND a.p_brand <> 'Brand#11'""")
def crosslist_propagate(t):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    listed = t("part").where("p_brand = 'Brand#11'").select(word.alias("w")).distinct()
    rows = t("part").where("p_brand <> 'Brand#11'").withColumn("w", word).join(listed, "w", "left_semi")
    return rows.select(F.col("p_partkey").alias("part_id"), F.lit("space_variant").alias("key"), F.lit("space_qualified").alias("text"), F.lit(8.0).alias("weight"))


@query("""SELECT part_id, round(mined, 6) AS mined, stored FROM (SELECT l_partkey AS part_id, avg(l_quantity) AS mined FROM lineitem GROUP BY 1) m JOIN (SELECT p_partkey AS part_id, CAST(p_size AS DOUBLE) AS stored FROM part) s USING (part_id)
 WHERE abs(stored - mined) / greatest(abs(stored), abs(mined), 1e-9) > 0.15""")
def conflict_join(t):
    mined = t("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.avg("l_quantity").alias("mined"))
    rows = mined.join(t("part").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("double").alias("stored")), "part_id")
    off = F.abs(F.col("stored") - F.col("mined")) / F.greatest(F.abs("stored"), F.abs("mined"), F.lit(1e-9))
    return rows.where(off > 0.15).select("part_id", r6(F.col("mined"), "mined"), "stored")


@query("SELECT min(page_id) AS page_id, url FROM (SELECT page_id, regexp_replace(url, '[?#].*', '') AS url FROM pages) GROUP BY url")
def url_dedupe(t):
    rows = t("pages").select("page_id", F.regexp_replace("url", r"[?#].*", "").alias("url"))
    return S.first(rows, ["url"], [F.col("page_id")])


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS turn FROM (SELECT page_id, {HOST} AS host FROM pages)")
def round_robin(t):
    return S.round_robin(t("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")), "host", [F.col("page_id")])


FRONTIER = f"frontier AS (SELECT page_id, url, {HOST} AS domain, (page_id * 37) % 101 AS priority FROM pages)"


def frontier(t):
    return t("pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), ((F.col("page_id") * 37) % 101).alias("priority"))


@query(f"WITH {FRONTIER} SELECT page_id, domain, priority FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, page_id) AS n FROM frontier) WHERE n <= 3")
def frontier_pop_budget(t):
    return S.pop(frontier(t), "domain", "priority", 3, "page_id").select("page_id", "domain", "priority")


@query(f"WITH {FRONTIER} SELECT page_id, CASE WHEN url ILIKE '%html%' OR url ILIKE '%page=%' THEN least(priority + 20, 100) ELSE priority END AS priority FROM frontier")
def frontier_boost(t):
    hit = F.col("url").ilike("%html%") | F.col("url").ilike("%page=%")
    return frontier(t).select("page_id", F.when(hit, F.least(F.col("priority") + 20, F.lit(100))).otherwise(F.col("priority")).alias("priority"))


@query(f"SELECT {HOST} AS domain, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS prefix, count(*) AS hits FROM pages GROUP BY 1, 2 HAVING count(*) >= 3")
def templates_min_hits(t):
    return t("pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("prefix")).agg(F.count("*").alias("hits")).where("hits >= 3")


@query(f"""WITH {SPECS} SELECT part_id, key, source, value FROM (SELECT *, row_number() OVER (PARTITION BY part_id, key, source ORDER BY s1 DESC, s2 DESC, value DESC) AS n FROM specs) WHERE n = 1""")
def upsert_latest(t):
    rows = t("lineitem").withColumnsRenamed({"l_partkey": "part_id", "l_suppkey": "source"})
    wide = R.wide_by_order(rows, ["part_id", "source"], VALUES, [F.col("l_orderkey"), F.col("l_linenumber")])
    return R.as_rows(wide, ["part_id", "source"], list(VALUES)).select("part_id", "key", "source", "value")


@query("""SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (value > 30), '') AS kind, coalesce(arg_max(props, event_id) FILTER (props <> ''), '') AS props FROM events GROUP BY 1""")
def upsert_text_fields(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("value") > 30, F.col("event_type")).otherwise("").alias("kind"), "props")
    return S.upsert_text(rows, ["user_id"], ["kind", "props"], "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 190)")
def resume_skip(t):
    return S.done(t("events"), t("events").where("value > 190"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT l_partkey AS part_id, count(*) AS n_specs, string_agg(l_suppkey || ':' || l_returnflag, ',' ORDER BY l_suppkey, l_returnflag) AS specs FROM lineitem GROUP BY 1")
def nested_export(t):
    rows = t("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.count("*").alias("n_specs"), F.array_sort(F.collect_list(F.struct("l_suppkey", "l_returnflag"))).alias("specs"))
    return rows.select("part_id", "n_specs", F.array_join(F.transform("specs", lambda s: F.concat_ws(":", s["l_suppkey"], s["l_returnflag"])), ",").alias("specs"))


@query("SELECT p_partkey AS part_id, upper(regexp_replace(p_name, '\\s+', '', 'g')) AS mpn_norm, regexp_replace(upper(p_name), '[^A-Z0-9+]', '', 'g') AS loose_plus, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS loose, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS vendor FROM part")
def loose_keys(t):
    return t("part").select(F.col("p_partkey").alias("part_id"), X.mpn_norm(F.col("p_name")).alias("mpn_norm"), X.loose_keep_plus(F.col("p_name")).alias("loose_plus"), X.loose(F.col("p_brand")).alias("loose"), X.vendor_norm(F.col("p_brand")).alias("vendor"))


@query("""WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
 SELECT CASE WHEN k <= 10 THEN value ELSE '(other)' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def spelling_survey(t):
    counts = t("part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(10).select("value").withColumn("kept", F.lit(True))
    return counts.join(F.broadcast(top), "value", "left").groupBy(F.when(F.col("kept"), F.col("value")).otherwise("(other)").alias("value")).agg(F.sum("n").alias("n"))
