"""Health of the store, matches and lookups, over the same store as the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions import text as X
from partlens.operators import health as H
from partlens.operators import lookup as U
from partlens.operators import mining as G

from .registry import query, r6
from .search import EVIDENCE, PARTS, STORE, evidence, parts, store

BASE = f"WITH {STORE}, {PARTS}, {EVIDENCE}"


@query(f"""{BASE}, held AS (SELECT DISTINCT part_id, key FROM store WHERE key IN ('gain_db', 'package', 'vswr')), size AS (SELECT category, count(*) AS parts FROM parts GROUP BY 1)
 SELECT category, k AS key, count(held.part_id) AS covered, max(size.parts) AS parts, round_even(100.0 * count(held.part_id) / max(size.parts), 1) AS percent FROM parts JOIN size USING (category) CROSS JOIN (VALUES ('gain_db'), ('package'), ('vswr')) v(k) LEFT JOIN held ON held.part_id = parts.part_id AND held.key = k GROUP BY 1, 2""")
def coverage_by_category(t):
    return H.coverage(parts(t), store(t), ["gain_db", "package", "vswr"])


PED = """ped AS (SELECT parts.part_id, mpn, CASE max(CASE WHEN key = 'space' THEN value_text END) WHEN 'qualified' THEN 'qualified' WHEN 'hi_rel' THEN 'hi_rel' ELSE 'none' END AS pedigree FROM parts LEFT JOIN store ON store.part_id = parts.part_id AND key = 'space' GROUP BY 1, 2)"""


@query(f"{BASE}, {PED} SELECT l AS pedigree, count(part_id) AS n FROM (VALUES ('qualified'), ('grade'), ('hi_rel'), ('none')) v(l) LEFT JOIN ped ON pedigree = l GROUP BY 1")
def pedigree_ladder(t):
    return H.pedigree_distribution(parts(t), store(t))


@query(f"{BASE}, {PED} SELECT count(*) AS families, CAST(coalesce(sum(n), 0) AS BIGINT) AS members, CAST(coalesce(sum(CASE WHEN g > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS spanning FROM (SELECT regexp_replace(split_part(mpn, ' ', 1), '-SP$', '') AS f, count(*) AS n, count(DISTINCT pedigree) AS g FROM ped GROUP BY 1 HAVING count(*) > 1)")
def family_spans(t):
    grades = H.pedigrees(parts(t), store(t))
    return H.families(parts(t).withColumn("mpn", F.concat(F.split_part("mpn", F.lit(" "), F.lit(1)), F.when(F.col("part_id") % 2 == 0, "-SP").otherwise(""))), grades)


@query(f"{BASE} SELECT (SELECT count(*) FROM parts) AS parts, count(DISTINCT part_id) AS covered, round_even(100.0 * count(DISTINCT part_id) / (SELECT count(*) FROM parts), 1) AS percent FROM store WHERE key = 'vswr'")
def radiation_coverage(t):
    rows = store(t).withColumn("key", F.when(F.col("key") == "vswr", "tid_krad").otherwise(F.col("key")))
    return H.radiation(parts(t), rows)


@query(f"{BASE} SELECT count(*) FILTER (a AND b) AS both_sources, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS other FROM (SELECT part_id, coalesce(bool_or(signal = 'A'), false) AS a, coalesce(bool_or(signal = 'R'), false) AS b FROM parts LEFT JOIN evidence USING (part_id) GROUP BY 1)")
def listing_overlap(t):
    return H.source_overlap(evidence(t), parts(t), "a%", "R%")


@query(f"{BASE} SELECT part_id, count(*) AS n_specs, bool_or(key = 'space' AND value_text = 'qualified') AS qualified FROM store GROUP BY 1")
def merge_inputs(t):
    rows = store(t).withColumn("value_text", F.when((F.col("key") == "space") & (F.col("value_text") == "qualified"), "space_qualified").otherwise(F.col("value_text")))
    return H.spec_counts(rows.withColumn("key", F.when(F.col("key") == "space", "space_variant").otherwise(F.col("key"))))


@query(f"{BASE}, best AS (SELECT part_id, key, coalesce(value_typ, value_max, value_min) AS v, confidence, seq FROM store WHERE key IN ('gain_db', 'vswr')) SELECT part_id, key, arg_max(v, {{'c': confidence, 's': -seq}}) FILTER (v IS NOT NULL) AS value FROM best GROUP BY 1, 2 HAVING count(v) > 0")
def best_values(t):
    return H.best_values(store(t).where("key IN ('gain_db', 'vswr')").withColumn("method", F.lit("catalog")))


@query(f"{BASE}, w AS (SELECT part_id, arg_min(value_text, seq) AS space FROM store WHERE key = 'space' GROUP BY 1) SELECT part_id, CASE WHEN space = 'qualified' THEN 'space=qualified' ELSE 'evidence=A-space' END AS reason FROM parts LEFT JOIN w USING (part_id) WHERE space = 'qualified' OR part_id IN (SELECT part_id FROM evidence WHERE signal = 'A')")
def qualification_reasons(t):
    rows = evidence(t).withColumn("signal", F.when(F.col("signal") == "A", "A-space").otherwise(F.col("signal")))
    return H.reasons(store(t).withColumn("source_url", F.lit("")), rows, parts(t))


@query(f"{BASE} SELECT 'evidence' AS \"table\", count(*) AS rows FROM evidence UNION ALL SELECT 'parts', count(*) FROM parts UNION ALL SELECT 'specs', count(*) FROM store")
def store_sizes(t):
    return H.described({"parts": parts(t), "specs": store(t), "evidence": evidence(t)})


@query("SELECT p_partkey AS part_id, CASE p_size % 6 WHEN 0 THEN 'CORRUPT' WHEN 1 THEN 'THIN' WHEN 2 THEN 'NO-SPECS' WHEN 3 THEN 'CONFLICT' WHEN 4 THEN 'FEW-SPECS' ELSE 'OK' END AS verdict, p_size % 2 = 1 AS disagrees FROM part")
def datasheet_verdicts(t):
    k = F.col("p_size") % 6
    out = H.verdict(F.when(k == 0, "corrupt").otherwise("pdf"), F.when(k == 1, 10).otherwise(900), F.when(k == 2, 0).otherwise(5), F.when(k == 4, 2).otherwise(4), F.when(k == 3, 1).otherwise(0))
    band = H.sane_band(F.lit(2.0), F.lit(18.0), F.lit(2.04), F.when(F.col("p_size") % 2 == 1, 20.0).otherwise(18.5))
    return t("part").select(F.col("p_partkey").alias("part_id"), out.alias("verdict"), band["disagrees"].alias("disagrees"))


LEVELS = "regexp_replace(upper(p_name), '[^A-Z0-9+]', '', 'g')"


@query(f"""WITH x AS (SELECT p_name AS k, min(p_partkey) AS m FROM part WHERE p_size > 45 GROUP BY 1), y AS (SELECT substr({LEVELS}, 1, 12) AS k, min(p_partkey) AS m FROM part WHERE p_size > 45 GROUP BY 1)
 SELECT p_partkey AS part_id, coalesce(x.m, y.m, -1) AS matched, CASE WHEN x.m IS NOT NULL THEN 'exact' WHEN y.m IS NOT NULL THEN 'loose' ELSE 'none' END AS level FROM part LEFT JOIN x ON x.k = p_name LEFT JOIN y ON y.k = substr({LEVELS}, 1, 12)""")
def match_levels(t):
    loosely = F.substring(X.loose_keep_plus(F.col("p_name")), 1, 12)
    rows = U.matched(t("part").select("p_partkey", "p_name"), t("part").where("p_size > 45").select("p_partkey", "p_name"), "p_name", [("exact", F.col("p_name")), ("loose", loosely)], "p_partkey")
    return rows.select(F.col("p_partkey").alias("part_id"), F.coalesce("matched", F.lit(-1)).alias("matched"), "level")


LISTED = "listed AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS mpn, CASE WHEN p_size % 3 = 0 THEN 'Dist' ELSE p_brand END AS vendor, p_brand AS manufacturer, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS price FROM part)"


@query(f"""WITH {LISTED}, near AS (SELECT * FROM listed WHERE vendor <> 'Dist'), keyed AS (SELECT upper(mpn) AS k, list(DISTINCT vendor) AS vendors FROM near GROUP BY 1), gone AS (SELECT DISTINCT upper(mpn) AS k, manufacturer AS m FROM listed JOIN keyed ON upper(mpn) = k WHERE vendor = 'Dist' AND list_contains(vendors, manufacturer))
 SELECT id, vendor, manufacturer FROM listed WHERE vendor <> 'Dist' OR (upper(mpn), manufacturer) NOT IN (SELECT (k, m) FROM gone)""")
def distributor_merge(t):
    rows = t("part").selectExpr("p_partkey AS id", "split_part(p_name, ' ', 1) AS mpn", "CASE WHEN p_size % 3 = 0 THEN 'Dist' ELSE p_brand END AS vendor", "p_brand AS manufacturer", "CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS price")
    return U.distributor_merge(rows, "Dist", [], ["price"]).select("id", "vendor", "manufacturer")


CURVE = "curve AS (SELECT l_suppkey AS k, l_linenumber * 7.0 AS f, avg(l_tax) AS v, avg(l_discount) AS w FROM lineitem GROUP BY 1, 2), asked AS (SELECT DISTINCT l_suppkey AS k, l_quantity AS f FROM lineitem)"


@query(f"""WITH {CURVE}, lo AS (SELECT a.k, a.f, max(c.f) AS g FROM asked a JOIN curve c ON c.k = a.k AND c.f <= a.f GROUP BY 1, 2), hi AS (SELECT a.k, a.f, min(c.f) AS h FROM asked a JOIN curve c ON c.k = a.k AND c.f >= a.f GROUP BY 1, 2)
 SELECT asked.k, asked.f, round(CASE WHEN g = h THEN x.v ELSE x.v + (y.v - x.v) * (asked.f - g) / (h - g) END, 6) AS v, round(CASE WHEN g = h THEN x.w ELSE x.w + (y.w - x.w) * (asked.f - g) / (h - g) END, 6) AS w FROM asked LEFT JOIN lo USING (k, f) LEFT JOIN hi USING (k, f) LEFT JOIN curve x ON x.k = asked.k AND x.f = g LEFT JOIN curve y ON y.k = asked.k AND y.f = h""")
def curve_values(t):
    """Two values of each curve at asked places by the samples around them; none outside."""
    samples = t("lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") * 7.0).alias("f")).agg(F.avg("l_tax").alias("v"), F.avg("l_discount").alias("w"))
    asked = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("f")).distinct()
    return U.interpolated(asked, samples, ["k"], "f", ["v", "w"]).select("k", "f", r6(F.col("v"), "v"), r6(F.col("w"), "w"))


@query("""WITH b AS (SELECT * FROM (VALUES (1.0, 10.0, 1.1), (10.0, 20.0, 1.3), (25.0, 40.0, 1.9)) v(lo, hi, vswr)), q AS (SELECT o_orderkey, CAST(o_totalprice / 5000 AS DOUBLE) AS f FROM orders) SELECT o_orderkey, CAST(coalesce((SELECT arg_min(vswr, lo) FROM b WHERE q.f >= lo AND q.f <= hi), CASE WHEN f < 1 THEN 1.1 WHEN f > 40 THEN 1.9 ELSE 1.9 END) AS DOUBLE) AS vswr FROM q""")
def band_lookup(t):
    """The first ascending band that holds the frequency; below the first, above the last held, in a gap the next."""
    bands = t("region").sparkSession.createDataFrame([(1.0, 10.0, 1.1), (10.0, 20.0, 1.3), (25.0, 40.0, 1.9)], "lo double, hi double, vswr double")
    rows = t("orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("f"))
    return U.piecewise(rows, bands, "f", "vswr").select("o_orderkey", "vswr")


@query("""SELECT doc_id, CASE WHEN k = 0 THEN 42.0 WHEN k = 1 THEN 0.0 WHEN k = 2 THEN 12.0 END AS percent, CASE WHEN k IN (0, 3) THEN 2.0 WHEN k = 1 THEN 4.0 END AS lo, CASE WHEN k IN (0, 3) THEN 18.0 WHEN k = 1 THEN 16.0 END AS hi, CASE WHEN k = 0 THEN 15.5 END AS gain, CASE WHEN k = 3 THEN 21.0 END AS p1db FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)""")
def mined_datasheets(t):
    """Bands among family spans and other ports, prose and table rows, evidence for and against space use."""
    text = F.expr("""CASE doc_id % 5 WHEN 0 THEN 'MAC Series Key Features 300 MHz to 12 GHz. RF frequency range 2 to 18 GHz. Small signal gain of 15.5 dB. Radiation hardened, hermetic, MMIC.'
 WHEN 1 THEN 'IQ mixer, RF 4 to 16 GHz with an IF DC to 6 GHz. Commercial grade only.' WHEN 2 THEN 'A hermetic part' WHEN 3 THEN 'operating frequency 2-18 GHz\nOutput P1dB (typ) dBm 21' ELSE 'nothing' END""")
    rows = t("documents").select("doc_id", text.alias("text"))
    out = G.mined(rows, "doc_id").groupBy("doc_id").pivot("spec", ["space_score_pct", "freq_min", "freq_max", "gain_db", "p1db_dbm"]).agg(F.max("value"))
    return rows.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.col("space_score_pct").alias("percent"), F.col("freq_min").alias("lo"), F.col("freq_max").alias("hi"), F.col("gain_db").alias("gain"), F.col("p1db_dbm").alias("p1db"))
