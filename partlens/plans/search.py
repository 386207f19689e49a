"""Candidates, criteria, filters and grids over a store of specifications made from `lineitem` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions import display as D
from partlens.functions import text as X
from partlens.functions import vocabulary as V
from partlens.functions.requirement import built, by_response
from partlens.operators import candidates as A
from partlens.operators import criteria as C
from partlens.operators import filters as L

from .registry import query

STORED = ["gain_db", "nf_db", "p1db_dbm", "insertion_loss_db", "vswr", "switching_speed_ns", "switching_time_ns", "freq_ghz", "rf_freq_min", "rf_freq_max", "if_freq_ghz", "rf_lo_freq_low", "rf_lo_freq_high",
          "lo_power_dbm_low", "lo_power_dbm_high", "gain_db@2-18GHz", "gain_db@18-40GHz", "connector", "space", "package", "directivity_db", "marketing", "noise@1-2GHz", "price_usd"]
PACKAGES = ["QFN, hermetic", "Die, Die", "Connectorized-SMA, Connectorized", "SOT-23"]
SEQ = "l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)"
TEXT = f"""CASE key WHEN 'connector' THEN CASE l_returnflag WHEN 'A' THEN 'SMA' WHEN 'R' THEN '2.92 mm' ELSE 'N, N' END WHEN 'space' THEN CASE l_returnflag WHEN 'A' THEN 'qualified' WHEN 'R' THEN 'hi_rel' ELSE 'none' END
 WHEN 'package' THEN CASE l_linenumber % 4 WHEN 0 THEN '{PACKAGES[0]}' WHEN 1 THEN '{PACKAGES[1]}' WHEN 2 THEN '{PACKAGES[2]}' ELSE '{PACKAGES[3]}' END WHEN 'marketing' THEN 'brand ' || l_returnflag END"""
FIELDS = f"""l_partkey AS part_id, key, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS value_min, CASE WHEN l_returnflag <> 'N' THEN l_quantity + 1 END AS value_typ, CASE WHEN l_linestatus = 'F' THEN l_quantity + 5 END AS value_max,
 {TEXT} AS value_text, 1 - l_discount AS confidence, {SEQ} AS seq"""
STORE = f"""store AS (SELECT {FIELDS} FROM (SELECT *, list_extract({STORED}, CAST(1 + (l_suppkey * 7 + l_linenumber * 3 + l_orderkey) % 24 AS BIGINT)) AS key FROM lineitem))"""


def store(t):
    keys = F.array(*map(F.lit, STORED))
    return t("lineitem").withColumn("key", F.get(keys, ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_orderkey")) % 24).cast("int"))).selectExpr(*split_fields(FIELDS))


def split_fields(fields: str) -> list[str]:
    """The expressions of a select list, apart at the commas outside of brackets, quotes and cases."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(fields):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(fields[at:i])
            at = i + 1
    return [*out, fields[at:]]


RESOLVED = STORE + """, ed AS (SELECT * REPLACE (CASE key WHEN 'switching_speed_ns' THEN 'switching_time_ns' ELSE key END AS key), coalesce(value_typ, value_min, value_max) AS st FROM store),
 e AS (SELECT part_id, seq, 'rf_freq_ghz' AS key, CASE WHEN key IN ('rf_freq_min', 'rf_lo_freq_low') THEN st END AS lo, CASE WHEN key IN ('rf_freq_max', 'rf_lo_freq_high') THEN st END AS hi FROM ed WHERE key IN ('rf_freq_min', 'rf_freq_max', 'rf_lo_freq_low', 'rf_lo_freq_high')
  UNION ALL SELECT part_id, seq, 'lo_freq_ghz', CASE WHEN key = 'rf_lo_freq_low' THEN st END, CASE WHEN key = 'rf_lo_freq_high' THEN st END FROM ed WHERE key IN ('rf_lo_freq_low', 'rf_lo_freq_high')
  UNION ALL SELECT part_id, seq, 'lo_power_dbm', CASE WHEN key = 'lo_power_dbm_low' THEN st END, CASE WHEN key = 'lo_power_dbm_high' THEN st END FROM ed WHERE key IN ('lo_power_dbm_low', 'lo_power_dbm_high')
  UNION ALL SELECT part_id, seq, 'if_freq_ghz', coalesce(value_min, st), coalesce(value_max, st) FROM ed WHERE key = 'if_freq_ghz'
  UNION ALL SELECT part_id, seq, 'freq_ghz', value_min, value_max FROM ed WHERE key = 'freq_ghz' AND value_min IS NOT NULL AND value_max IS NOT NULL),
 edge AS (SELECT part_id, key, arg_max(lo, seq) FILTER (lo IS NOT NULL) AS l, arg_max(hi, seq) FILTER (hi IS NOT NULL) AS h FROM e GROUP BY 1, 2),
 num AS (SELECT part_id, CASE key WHEN 'nf_db' THEN 'noise_nf_db' ELSE key END AS key, confidence, seq, value_text, CASE WHEN key IN ('gain_db', 'p1db_dbm') THEN coalesce(value_min, value_typ, value_max)
  WHEN key IN ('nf_db', 'insertion_loss_db', 'vswr', 'switching_time_ns') THEN coalesce(value_max, value_typ, value_min) ELSE coalesce(value_typ, value_max, value_min) END AS v FROM ed
  WHERE key IN ('gain_db', 'p1db_dbm', 'nf_db', 'insertion_loss_db', 'vswr', 'switching_time_ns', 'directivity_db', 'marketing', 'price_usd')),
 plain AS (SELECT part_id, key, arg_max(v, {'c': confidence, 's': seq}) FILTER (v IS NOT NULL) AS value, arg_min(value_text, seq) FILTER (v IS NULL AND value_text IS NOT NULL) AS text FROM num GROUP BY 1, 2),
 said AS (SELECT part_id, key, arg_max(value_text, seq) AS text FROM ed WHERE key IN ('connector', 'space', 'package') GROUP BY 1, 2),
 banded AS (SELECT part_id, seq, substr(key, 9) AS label, CASE key WHEN 'gain_db@2-18GHz' THEN 2 ELSE 18 END AS f, CASE key WHEN 'gain_db@2-18GHz' THEN 18 ELSE 40 END AS u, coalesce(value_min, value_typ, value_max) AS v FROM ed WHERE key LIKE 'gain_db@%'),
 """
CHOSEN = {
    True: """pick AS (SELECT part_id, v, label FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY (f <= 10 AND u >= 30) DESC, least(u, 30) - greatest(f, 10) DESC, seq) AS n FROM banded WHERE least(u, 30) > greatest(f, 10)) WHERE n = 1 AND v IS NOT NULL),""",
    False: """pick AS (SELECT part_id, v, label FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY v, seq) AS n FROM banded WHERE v IS NOT NULL) WHERE n = 1),""",
}
UNION = """ resolved AS (SELECT part_id, key, CASE WHEN key = 'gain_db' THEN coalesce(v, value) ELSE value END AS value, CASE WHEN value IS NULL AND NOT (key = 'gain_db' AND v IS NOT NULL) THEN text END AS text, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi,
  CASE WHEN key = 'gain_db' THEN label END AS band FROM (SELECT part_id, key, value, text FROM plain UNION ALL SELECT part_id, 'gain_db', NULL, NULL FROM pick WHERE part_id NOT IN (SELECT part_id FROM plain WHERE key = 'gain_db')) LEFT JOIN pick USING (part_id)
  UNION ALL SELECT part_id, key, NULL, text, NULL, NULL, NULL FROM said UNION ALL SELECT part_id, key, NULL, NULL, CASE WHEN l > h THEN h ELSE l END, CASE WHEN l > h THEN l ELSE h END, NULL FROM edge)"""
ALL = "SELECT part_id, key, value, text, lo, hi, band FROM resolved WHERE value IS NOT NULL OR text IS NOT NULL OR lo IS NOT NULL OR hi IS NOT NULL"


@query(f"WITH {RESOLVED}{CHOSEN[True]}{UNION} {ALL}")
def candidate_specs(t):
    return A.resolve(store(t), (10, 30))


@query(f"WITH {RESOLVED}{CHOSEN[False]}{UNION} {ALL}")
def candidate_specs_any_band(t):
    return A.resolve(store(t))


PARTS = """parts AS (SELECT p_partkey AS part_id, p_name AS mpn, CASE p_size % 4 WHEN 0 THEN 'Hittite Microwave' WHEN 1 THEN 'Mini-Circuits Ltd.' WHEN 2 THEN 'Unheard Of, Inc' ELSE p_brand END AS vendor, CASE WHEN p_size % 3 = 0 THEN 'amplifier' WHEN p_size % 3 = 1 THEN 'divider' ELSE '' END AS category,
 CASE WHEN p_size % 5 = 0 THEN 'lna' ELSE '' END AS subcategory, 'http://' || lower(p_brand) || '.com/x' AS product_url, p_type || ' ' || (1 + p_size % 8) || '-way' AS description, p_retailprice AS last_seen FROM part)"""


def parts(t):
    sql = PARTS[PARTS.index("SELECT ") + 7 : PARTS.rindex(" FROM part)")]
    return t("part").selectExpr(*split_fields(sql))


EVIDENCE = f"evidence AS (SELECT l_partkey AS part_id, l_returnflag AS signal, CASE l_linestatus WHEN 'F' THEN 2.0 ELSE -1.5 END AS weight, '' AS snippet, {SEQ} AS seq FROM lineitem)"


def evidence(t):
    return t("lineitem").selectExpr("l_partkey AS part_id", "l_returnflag AS signal", "CASE l_linestatus WHEN 'F' THEN 2.0D ELSE -1.5D END AS weight", "'' AS snippet", f"{SEQ} AS seq")


MOUNTED = {PACKAGES[0]: ("QFN, hermetic", "surface-mount", "QFN", "yes"), PACKAGES[1]: ("Die", "die", None, None), PACKAGES[2]: ("Connectorized-SMA, Connectorized", "connectorized", "SMA", None), PACKAGES[3]: ("SOT-23", None, "SOT-23", None)}
# a hyphen doesn't end a word: SOT-23 is a body that is also a mount
MOUNTED[PACKAGES[3]] = ("SOT-23", "surface-mount", "SOT-23", None)
CASES = lambda i: "CASE package " + " ".join(f"WHEN '{k}' THEN {'NULL' if v[i] is None else repr(v[i])}" for k, v in MOUNTED.items()) + " END"
WIDE = """, wide AS (SELECT part_id, max(value) FILTER (key = 'noise_nf_db') AS nf, max(value) FILTER (key = 'insertion_loss_db') AS il, max(text) FILTER (key = 'package') AS package, max(text) FILTER (key = 'connector') AS connector, max(text) FILTER (key = 'space') AS space,
 max(value) FILTER (key = 'gain_db') AS gain, max(value) FILTER (key = 'p1db_dbm') AS p1db, max(value) FILTER (key = 'price_usd') AS price, max(value) FILTER (key = 'vswr') AS vswr, max(lo) FILTER (key = 'freq_ghz') AS lo, max(hi) FILTER (key = 'freq_ghz') AS hi FROM (""" + ALL + """) GROUP BY 1)"""
VENDOR = "CASE vendor WHEN 'Hittite Microwave' THEN 'Analog Devices' WHEN 'Mini-Circuits Ltd.' THEN 'Mini-Circuits' ELSE vendor END"


def candidates(t, **options):
    return A.assemble(parts(t), store(t), evidence(t), **options)


@query(f"""WITH {RESOLVED}{CHOSEN[True]}{UNION}{WIDE}, {PARTS}, {EVIDENCE}, ev AS (SELECT part_id, string_agg(signal || CASE weight WHEN 2.0 THEN ' +2' ELSE ' -1.5' END, ', ' ORDER BY seq) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY seq, signal, weight) AS n FROM evidence) WHERE n <= 6 GROUP BY 1)
 SELECT part_id, {VENDOR} AS vendor, vendor AS vendor_raw, nullif(category, '') AS category, nullif(subcategory, '') AS subcategory, coalesce(summary, '') AS qual_summary, coalesce(nf, abs(il)) AS nf, CASE WHEN nf IS NULL AND il IS NOT NULL THEN 'insertion_loss_db' END AS nf_from,
 {CASES(0)} AS package, {CASES(1)} AS mount_type, {CASES(2)} AS body, {CASES(3)} AS hermetic, CASE connector WHEN 'N, N' THEN 'N' ELSE connector END AS connector FROM parts LEFT JOIN wide USING (part_id) LEFT JOIN ev USING (part_id) WHERE (lo IS NULL OR hi IS NULL OR (lo <= 10 + 1e-9 AND hi >= 30 - 1e-9))""")
def candidate_assembly(t):
    """Every part's record: key map, renames, bands, arbitration, derived noise, packages, vendors, evidence; parts that state another band left out."""
    rows = candidates(t, wanted=(10.0, 30.0))
    return rows.select("part_id", "vendor", "vendor_raw", "category", "subcategory", "qual_summary", C.number("noise_nf_db").alias("nf"), C.text("noise_nf_db_from").alias("nf_from"), C.text("package").alias("package"), C.text("mount_type").alias("mount_type"), C.text("package_body").alias("body"), C.text("hermetic").alias("hermetic"), C.text("connector").alias("connector"))


@query(f"WITH {RESOLVED}{CHOSEN[False]}{UNION}{WIDE}, {PARTS} SELECT part_id, last_seen FROM parts LEFT JOIN wide USING (part_id) WHERE category = 'amplifier' AND lo <= 25 + 1e-9 AND hi >= 25 - 1e-9 ORDER BY last_seen DESC, part_id LIMIT 25")
def recent_candidates(t):
    """One category, parts without a stated band left out, the most recent ones after the filter."""
    return candidates(t, category="amplifier", wanted=(25.0, 25.0), unstated=False, limit=25).select("part_id", "last_seen")


@query(f"WITH {PARTS} SELECT part_id, vendor AS vendor_raw FROM parts WHERE vendor IN ('Hittite Microwave', 'Brand#11') AND part_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)")
def chosen_candidates(t):
    return candidates(t, vendors=["Hittite Microwave", "Brand#11"], ids=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]).select("part_id", "vendor_raw")


ASKED = built(category="Gain Block", freq="10-20 GHz", gain_db_min=20.0, nf_db_max=30.0, p1db_dbm_min=15.0, connector="sma", package="surface-mount", space=True)
STATES = f"""{RESOLVED}{CHOSEN[True].replace("30", "20")}{UNION}{WIDE}, {PARTS}, st AS (SELECT part_id, category, subcategory, price, space, description, mpn,
 (category = 'amplifier' OR contains(lower(mpn), 'amp') OR contains(lower(product_url), 'amp') OR contains(lower(mpn), 'lna') OR contains(lower(mpn), 'gain block')) AS c1,
 CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo <= 10 AND hi >= 20 END AS c2, gain >= 20 AS c3, coalesce(nf, abs(il)) <= 30 AS c4, p1db >= 15 AS c5, contains(upper(replace(connector, ' ', '')), 'SMA') AS c6, {CASES(1)} = 'smt' AS c7,
 CASE WHEN space = 'qualified' THEN true END AS c8 FROM parts LEFT JOIN wide USING (part_id)),
 counted AS (SELECT *, {' + '.join(f'(CASE WHEN c{i} THEN 1 ELSE 0 END)' for i in range(1, 9))} AS met, {' + '.join(f'(CASE WHEN c{i} IS NULL THEN 1 ELSE 0 END)' for i in range(1, 9))} AS unknown, CASE space WHEN 'qualified' THEN 6 WHEN 'hi_rel' THEN 4 ELSE 0 END AS points FROM st),
 scored AS (SELECT *, 8 - met - unknown AS miss, CAST(greatest(0, least(100, round_even(0.94 * (100 * met + 45 * unknown) / 8 + points, 0))) AS INTEGER) AS fit, CASE WHEN 8 - met - unknown > 0 THEN 'C' WHEN unknown > 0 THEN 'B' ELSE 'A' END AS tier,
 CASE WHEN category = 'divider' THEN coalesce(nullif(TRY_CAST(regexp_extract(description, '([0-9]+)-way', 1) AS INTEGER), 0), 1000000) ELSE 0 END AS ways FROM counted)"""


def described(t):
    rows = candidates(t, wanted=None).withColumnsRenamed({"mpn": "model", "product_url": "url"})
    return rows.withColumn("title", F.col("model"))


@query(f"WITH {STATES} SELECT part_id, CAST(met AS INTEGER) AS met, CAST(miss AS INTEGER) AS miss, CAST(unknown AS INTEGER) AS unknown, fit, tier, CAST(points AS DOUBLE) AS space_score FROM scored")
def criteria_states(t):
    """Eight criteria over resolved specifications: category by words, band, at least, at most, connector, package, space."""
    return ranked_for(t).select("part_id", "met", "miss", "unknown", F.col("fit_score").alias("fit"), "tier", "space_score")


def ranked_for(t):
    own = A.assemble(parts(t), store(t), evidence(t).limit(0), wanted=None)
    at_band = A.records(A.resolve(store(t), (10, 20)))
    rows = own.drop("specs").join(at_band, "part_id", "left").withColumn("specs", F.coalesce("specs", F.create_map().cast(f"map<string,{A.RESOLVED}>")))
    rows = rows.withColumnsRenamed({"mpn": "model", "product_url": "url"}).withColumn("title", F.col("model"))
    return C.evaluate(rows, ASKED)


@query(f"WITH {STATES} SELECT part_id, tier, fit FROM scored ORDER BY tier, fit DESC, ways, unknown, points DESC, met DESC, price NULLS LAST, part_id LIMIT 40")
def search_ranked(t):
    """The whole order: tier, fit, ways of dividers, unknowns, space, met, price."""
    return ranked_for(t).orderBy(*C.order(ASKED)).limit(40).select("part_id", "tier", F.col("fit_score").alias("fit"))


@query(f"""WITH {RESOLVED}{CHOSEN[False]}{UNION}{WIDE}, {PARTS}, d AS (SELECT part_id, abs(hi - 30) AS delta FROM parts LEFT JOIN wide USING (part_id)) SELECT part_id, round(coalesce(delta, 1e9), 6) AS delta, CASE WHEN delta IS NULL THEN 'unknown' WHEN delta <= 3 THEN 'met' ELSE 'miss' END AS state FROM d
 ORDER BY coalesce(delta, 1e9), CASE WHEN delta <= 3 THEN 'A' WHEN delta IS NULL THEN 'B' ELSE 'C' END, part_id LIMIT 60""")
def cutoff_search(t):
    """Low passes by the distance of their cutoff from the one asked for."""
    asked = by_response(built(freq="5-30"), "lowpass")
    rows = C.evaluate(described(t), asked)
    return rows.orderBy(F.col("cutoff_delta"), "tier", "part_id").limit(60).select("part_id", F.round(F.least(F.col("cutoff_delta"), F.lit(1e9)), 6).alias("delta"), F.try_element_at("criteria", F.lit("cutoff")).alias("state"))


@query(f"""WITH {RESOLVED}{CHOSEN[False]}{UNION}{WIDE}, {PARTS} SELECT part_id FROM parts JOIN wide USING (part_id) WHERE gain >= 10 AND gain <= 40 AND nf <= 45 AND contains(lower(coalesce(connector, '')), 'sm') AND lower(trim(coalesce(space, ''))) IN ('qualified', 'hi_rel')""")
def grid_filters(t):
    """The grid's filters: a range, an upper bound, contained text, any of some texts."""
    return candidates(t).where(L.spec_filters([("gain_db", "range", "40-10"), ("noise_nf_db", "range", "<45"), ("connector", "text", " SM "), ("space", "anyof", ["Qualified", "hi_rel"]), ("vswr", "range", "half typed")])).where(C.number("noise_nf_db_from").isNull() & C.text("noise_nf_db_from").isNull()).select("part_id")


@query(f"WITH {RESOLVED}{CHOSEN[False]}{UNION}, r AS ({ALL}) SELECT key, count(*) AS n FROM r GROUP BY 1")
def spec_key_catalogue(t):
    """The keys that results state, with how many parts state them: which columns a grid shows."""
    return A.resolve(store(t)).groupBy("key").agg(F.count("*").alias("n"))


TITLE = "CASE p_size % 6 WHEN 0 THEN 'Low Noise Amplifier' WHEN 1 THEN 'high power amplifier' WHEN 2 THEN 'gain block' WHEN 3 THEN 'amplifier' WHEN 4 THEN 'Variable Gain Amplifier' ELSE 'driver amplifier, low noise amplifier' END"
MODEL = "CASE p_size % 7 WHEN 0 THEN 'ZHL-' || p_partkey WHEN 1 THEN 'PMA-' || p_partkey || '-2W+' WHEN 2 THEN 'DVGA-' || p_partkey WHEN 3 THEN 'LNX' || p_partkey ELSE 'XA-' || p_partkey END"
CLASS = f"""cls AS (SELECT *, CASE WHEN model LIKE 'ZHL%' OR model LIKE '%-2W+' THEN 'high_power' WHEN contains(model, 'LN') THEN 'lna' WHEN model LIKE 'DVGA%' THEN 'vga' WHEN nf <= 1.5 THEN 'lna' WHEN power >= 33 THEN 'high_power' ELSE 'gain_block' END AS class
 FROM (SELECT p_partkey AS part_id, {TITLE} AS title, {MODEL} AS model, CASE WHEN p_size % 4 = 0 THEN 'hpa' WHEN p_size % 4 = 1 THEN 'lna' WHEN p_size % 4 = 2 THEN 'odd' ELSE '' END AS subcategory, CASE WHEN p_size % 9 = 0 THEN 1.0 WHEN p_size % 9 = 1 THEN 4.0 END AS nf, CASE WHEN p_size % 8 = 0 THEN 36.0 WHEN p_size % 8 = 3 THEN 20.0 END AS power FROM part))"""


def amplifiers(t):
    number = lambda c: f"named_struct('value', {c}, 'text', CAST(NULL AS STRING), 'lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE))"
    nf, power = "CAST(CASE WHEN p_size % 9 = 0 THEN 1.0 WHEN p_size % 9 = 1 THEN 4.0 END AS DOUBLE)", "CAST(CASE WHEN p_size % 8 = 0 THEN 36.0 WHEN p_size % 8 = 3 THEN 20.0 END AS DOUBLE)"
    return t("part").selectExpr("p_partkey AS part_id", f"{TITLE} AS title", f"{MODEL} AS model", "'' AS text", "CASE WHEN p_size % 4 = 0 THEN 'hpa' WHEN p_size % 4 = 1 THEN 'lna' WHEN p_size % 4 = 2 THEN 'odd' ELSE '' END AS subcategory", f"map('nf_db', {number(nf)}, 'p1db_dbm', {number(power)}) AS specs")


@query(f"WITH {CLASS} SELECT part_id, class FROM cls")
def amplifier_classes(t):
    return amplifiers(t).select("part_id", L.amplifier_class(F.col("model"), C.number("nf_db"), C.number("p1db_dbm")).alias("class"))


SIBLINGS = [w for w in V.excluded_by("amplifier", "lna")]


@query(f"""WITH {CLASS} SELECT part_id, title, class FROM cls WHERE CASE WHEN subcategory IN ('pa', 'hpa', 'driver', 'vga', 'if', 'buffer', 'log') THEN false WHEN contains(lower(title), 'low noise amplifier') OR contains(lower(title), 'lna') THEN true
 WHEN class IN ('high_power', 'vga') THEN false ELSE NOT ({' OR '.join(f"contains(lower(title), '{w}')" for w in SIBLINGS)}) END""")
def sibling_filter_amplifiers(t):
    """A search for low noise: stored siblings go, named ones stay, other classes go, then other names."""
    rows = L.subcategory(amplifiers(t), "amplifier", "lna")
    return rows.select("part_id", "title", L.amplifier_class(F.col("model"), C.number("nf_db"), C.number("p1db_dbm")).alias("class"))


@query("SELECT p_partkey AS part_id, p_size % 8 AS ways FROM part WHERE p_size % 8 IN (0, 4)")
def divider_ways_filter(t):
    rows = t("part").select(F.col("p_partkey").alias("part_id"), (F.col("p_size") % 8).alias("ways"))
    return L.subcategory(rows, "divider", "4way", F.col("ways"))


@query(f"WITH {PARTS} SELECT {VENDOR} AS vendor, count(*) AS n FROM parts GROUP BY 1")
def canonical_vendors(t):
    return parts(t).groupBy(X.canonical_vendor(F.col("vendor")).alias("vendor")).agg(F.count("*").alias("n"))


@query(f"WITH {PARTS} SELECT part_id, vendor FROM parts WHERE regexp_replace(lower(vendor), '[^a-z0-9]', '', 'g') NOT IN ('hittitemicrowave', 'brand11')")
def vendor_exclusion(t):
    return parts(t).where(~L.vendor_excluded(F.col("vendor"), ["Hittite-Microwave", "brand 11"])).select("part_id", "vendor")


@query(f"WITH {RESOLVED}{CHOSEN[False]}{UNION}{WIDE} SELECT part_id FROM wide WHERE space <> '' AND space IS NOT NULL")
def space_any(t):
    return A.records(A.resolve(store(t))).where(L.space_fits(C.text("space"), "any-space")).select("part_id")


@query("SELECT p_partkey AS part_id, (length(pn) BETWEEN 3 AND 40) AND regexp_matches(pn, '[0-9]') AND NOT regexp_matches(pn, '[-_][A-Za-z]{4,}([-_]|$)') AS shaped, NOT regexp_matches(pn, '(?i)^(evb|eval)|[-_]kit$') AS orderable FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN 'EVB-' || p_partkey WHEN 1 THEN split_part(p_name, ' ', 1) || '-' || p_size WHEN 2 THEN p_size || '-' || split_part(p_name, ' ', 2) WHEN 3 THEN p_partkey || '-kit' ELSE p_name END AS pn FROM part)")
def part_number_shapes(t):
    pn = F.expr("CASE p_size % 5 WHEN 0 THEN 'EVB-' || p_partkey WHEN 1 THEN split_part(p_name, ' ', 1) || '-' || p_size WHEN 2 THEN p_size || '-' || split_part(p_name, ' ', 2) WHEN 3 THEN p_partkey || '-kit' ELSE p_name END")
    return t("part").select(F.col("p_partkey").alias("part_id"), L.part_number_shaped(pn).alias("shaped"), L.orderable(pn).alias("orderable"))


@query("SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value < 50 AND user_id NOT IN (SELECT user_id FROM events WHERE value > 280)) WHERE k <= 3 GROUP BY 1")
def fetch_targets(t):
    """The first three missing rows of each vendor; rows of some vendors are dead."""
    rows = t("events").select(F.col("event_id").alias("part_id"), F.col("event_id").alias("mpn"), F.col("user_id").cast("string").alias("vendor"), "user_id", "value")
    gone = rows.where("value > 280").select("user_id").distinct()
    dead = rows.join(gone, "user_id", "left_semi").select("part_id")
    found = L.fetch_targets(rows, rows.where("value >= 50").select("part_id"), dead, rows.limit(0).select("part_id"), ["%"], 3)
    return found.groupBy("user_id").agg(F.min("part_id").alias("first_event"), F.count("*").alias("n"))


@query("""SELECT p_partkey AS part_id, CASE WHEN p_size = 0 THEN 'in stock' WHEN p_size % 10 = 0 THEN '?' ELSE '~' || p_size || ' wk' END AS lead, '$' || format('{:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)) AS price, CASE WHEN p_size < 10 THEN p_size || '%' WHEN p_size < 20 THEN '' ELSE (p_size * 2) || '%' END AS pct,
 CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 20 THEN 'neutral' WHEN p_size * 2 >= 70 THEN 'high' WHEN p_size * 2 >= 40 THEN 'middle' ELSE 'low' END AS shade, p_size || '–' || (p_size + 0.5) AS band, CASE WHEN p_size < 30 THEN (p_size * 33) || ' ns' ELSE (p_size * 33 / 1000.0)::DECIMAL(9, 3)::DOUBLE || ' µs' END AS time FROM part WHERE p_size * 33 < 990 OR p_size * 33 >= 1000""")
def grid_cells(t):
    """Lead times, prices, percentages with their shades, bands and times as a grid shows them."""
    size = F.col("p_size").cast("double")
    pct = F.when(size < 10, size).when(size >= 20, size * 2)
    cell = D.space_percent(pct)
    return t("part").where("p_size * 33 < 990 OR p_size * 33 >= 1000").select(F.col("p_partkey").alias("part_id"), D.lead(F.when((F.col("p_size") % 10 != 0) | (size == 0), size)).alias("lead"), D.price(F.col("p_retailprice")).alias("price"), cell["text"].alias("pct"), cell["shade"].alias("shade"), D.band(size, size + 0.5).alias("band"), D.time_ns(size * 33).alias("time"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'everythingrf') THEN 'everythingRF' WHEN contains(lower(url), 'satnow') THEN 'SATNow' WHEN contains(lower(url), 'digikey') OR contains(lower(url), 'digi-key') THEN 'DigiKey' ELSE 'other' END AS source FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.everythingRF.com/' || page_id WHEN 1 THEN 'https://SATNow.com' WHEN 2 THEN 'x.digi-key.com' ELSE url END AS url FROM pages)")
def source_labels(t):
    url = F.expr("CASE page_id % 5 WHEN 0 THEN 'https://www.everythingRF.com/' || page_id WHEN 1 THEN 'https://SATNow.com' WHEN 2 THEN 'x.digi-key.com' ELSE url END")
    return t("pages").select("page_id", D.source(url).alias("source"))

