"""Measurement analysis, text classification, text mining and network formulas over the dataset's stand-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import text as X
from partlens.operators import classify as C
from partlens.operators import lookup as U
from partlens.operators import measurements as M

from .registry import query, r6

MEASURE = """measure AS (SELECT l_returnflag AS dut, l_suppkey AS test, l_orderkey AS report, l_quantity AS data, 2.0 AS lower, CASE WHEN l_linestatus = 'F' THEN 48.0 ELSE 46.0 END AS upper, l_linenumber AS seq, l_partkey, l_extendedprice FROM lineitem)"""
CELLS = MEASURE + """, cells AS (SELECT report, test, max(CASE WHEN data > upper OR data < lower THEN 1 ELSE 0 END) AS failed, avg(data) AS mean FROM measure GROUP BY 1, 2)"""


def measure(t):
    upper = F.when(F.col("l_linestatus") == "F", 48.0).otherwise(46.0)
    return t("lineitem").select(F.col("l_returnflag").alias("dut"), F.col("l_suppkey").alias("test"), F.col("l_orderkey").alias("report"), F.col("l_quantity").alias("data"), F.lit(2.0).alias("lower"), upper.alias("upper"), F.col("l_linenumber").alias("seq"), "l_partkey", "l_extendedprice")


@query(f"WITH {MEASURE} SELECT dut, test, count(data) AS n, round(avg(data), 6) AS mean, round(stddev_samp(data), 6) AS sd, max(upper) AS upper, min(lower) AS lower FROM measure GROUP BY 1, 2")
def pair_stats(t):
    return M.pair_stats(measure(t)).select("dut", "test", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "upper", "lower")


@query(f"""WITH {MEASURE} SELECT dut, test, round(CASE WHEN sd > 0 THEN least((u - m) / (3 * sd), (m - l) / (3 * sd)) END, 6) AS cpk FROM
 (SELECT dut, test, avg(data) AS m, stddev_samp(data) AS sd, max(upper) AS u, min(lower) AS l FROM measure GROUP BY 1, 2)""")
def cpk(t):
    return M.pair_stats(measure(t)).select("dut", "test", r6(F.col("cpk"), "cpk"))


@query(f"WITH {CELLS} SELECT report, test, failed, round(mean, 6) AS mean FROM cells")
def report_cells(t):
    return M.cells(measure(t)).select("report", "test", "failed", r6(F.col("mean"), "mean"))


@query(f"WITH {MEASURE} SELECT report, test, seq, data, round(least(upper - data, data - lower) / ((upper - lower) / 2), 6) AS margin FROM measure")
def margin(t):
    return measure(t).select("report", "test", "seq", "data", r6(N.margin(F.col("data"), F.col("lower"), F.col("upper"), F.lit(1.0)), "margin"))


@query(f"""WITH {CELLS}, share AS (SELECT report, count(*) AS tests, avg(failed) AS share FROM cells GROUP BY 1 HAVING count(*) >= 4), mid AS (SELECT median(share) AS mid, count(*) AS n FROM share),
 mad AS (SELECT median(abs(share - mid)) AS mad FROM share, mid) SELECT report, tests, round(share, 6) AS share, n >= 5 AND share > greatest(0.30, mid + 3 * 1.4826 * mad) AS dead FROM share, mid, mad""")
def dead_reports(t):
    return M.dead_reports(M.cells(measure(t)), 4, 5).select("report", "tests", r6(F.col("share"), "share"), "dead")


@query("""SELECT c_mktsegment AS dut, c_nationkey AS test, c_custkey AS seq, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS report_no,
 c_mktsegment || '_R' || lpad(CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS VARCHAR), 6, '0') AS report FROM customer""")
def synth_reports_occurrence(t):
    rows = t("customer").select(F.col("c_mktsegment").alias("dut"), F.col("c_nationkey").alias("test"), F.col("c_custkey").alias("seq"))
    return M.occurrence_reports(rows, [F.col("seq")]).select("dut", "test", "seq", "report_no", "report")


@query("""WITH e AS (SELECT user_id AS dut, event_id AS seq, epoch(ts) AS ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS gap FROM events),
 m AS (SELECT dut, median(gap) AS usual FROM e GROUP BY 1) SELECT dut, seq, CAST(sum(CASE WHEN gap IS NULL OR gap > greatest(600, 3 * greatest(coalesce(usual, 1), 1)) THEN 1 ELSE 0 END) OVER (PARTITION BY dut ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e JOIN m USING (dut)""")
def synth_reports_time(t):
    ts = F.unix_micros(F.to_timestamp("ts")) / 1e6
    rows = t("events").select(F.col("user_id").alias("dut"), F.col("event_id").alias("seq"), ts.alias("ts"))
    return M.time_reports(rows, 600, 3).select("dut", "seq", "session")


@query("""SELECT g, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT g, v, r - row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM (SELECT DISTINCT p_brand AS g, p_size AS v FROM part) JOIN
 (SELECT v, row_number() OVER (ORDER BY v) AS r FROM (SELECT DISTINCT p_size AS v FROM part)) USING (v)) GROUP BY g, i HAVING count(*) >= 2""")
def param_islands(t):
    return M.islands(t("part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("v")), "g", "v")


JOINT = CELLS + """, f AS (SELECT report, test FROM cells WHERE failed = 1), here AS (SELECT f.test, c.test AS other, count(*) AS n FROM f JOIN cells c USING (report) GROUP BY 1, 2),
 joint AS (SELECT x.test AS a, y.test AS b, count(*) AS joint FROM f x JOIN f y USING (report) WHERE x.test < y.test GROUP BY 1, 2)"""


@query(f"""WITH {JOINT} SELECT a, b, joint, round(joint / (p.n + q.n - joint), 6) AS similarity FROM joint JOIN here p ON p.test = a AND p.other = b JOIN here q ON q.test = b AND q.other = a WHERE joint >= 1 AND joint / (p.n + q.n - joint) >= 0.1""")
def cofailure_pairs(t):
    return M.cofailures(M.cells(measure(t)), 1, 0.1).select("a", "b", "joint", r6(F.col("similarity"), "similarity"))


@query(f"""WITH {CELLS}, f AS (SELECT test, count(*) OVER (PARTITION BY report) AS k FROM cells WHERE failed = 1) SELECT test, count(*) AS fail_reports, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sole FROM f GROUP BY 1""")
def key_tests(t):
    return M.key_tests(M.cells(measure(t)))


@query(f"""WITH {CELLS}, per AS (SELECT test, sum(failed) AS fails, count(*) AS n FROM cells GROUP BY 1) SELECT substr(CAST(test AS VARCHAR), 1, 1) AS digit, bool_and(fails = 0) AS never_failed, bool_and(fails < 3) AS all_rare, CAST(sum(fails) AS BIGINT) AS fails, count(*) AS tests,
 string_agg(CAST(test AS VARCHAR), ' | ' ORDER BY CAST(test AS VARCHAR)) AS members FROM per GROUP BY 1""")
def digit_rollup(t):
    per = M.cells(measure(t)).groupBy("test").agg(F.sum("failed").alias("fails"))
    name = F.col("test").cast("string")
    rows = per.groupBy(F.substring(name, 1, 1).alias("digit")).agg(F.bool_and(F.col("fails") == 0).alias("never_failed"), F.bool_and(F.col("fails") < 3).alias("all_rare"), F.sum("fails").alias("fails"), F.count("*").alias("tests"), F.array_sort(F.collect_list(name)).alias("m"))
    return rows.select("digit", "never_failed", "all_rare", "fails", "tests", F.array_join("m", " | ").alias("members"))


@query(f"""WITH {CELLS}, per AS (SELECT test, sum(failed) AS fails FROM cells GROUP BY 1) SELECT substr(CAST(test AS VARCHAR), 1, 1) AS digit, count(*) AS total, CAST(sum(CASE WHEN fails < 3 THEN 1 ELSE 0 END) AS BIGINT) AS cut,
 round(100.0 * sum(CASE WHEN fails < 3 THEN 1 ELSE 0 END) / count(*), 6) AS percent FROM per GROUP BY 1""")
def cut_percentage(t):
    per = M.cells(measure(t)).groupBy("test").agg(F.sum("failed").alias("fails"))
    cut = F.sum((F.col("fails") < 3).cast("long"))
    return per.groupBy(F.substring(F.col("test").cast("string"), 1, 1).alias("digit")).agg(F.count("*").alias("total"), cut.alias("cut"), r6(100.0 * cut / F.count("*"), "percent"))


@query(f"WITH {CELLS} SELECT count(DISTINCT report) AS escapes FROM cells WHERE failed = 1 AND report NOT IN (SELECT report FROM cells WHERE failed = 1 AND test % 3 <> 0)")
def escape_count(t):
    fails = M.cells(measure(t)).where("failed = 1")
    return fails.join(fails.where("test % 3 <> 0").select("report").distinct(), "report", "left_anti").agg(F.count_distinct("report").alias("escapes"))


WILSON = "(p + z * z / (2 * n) {} z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)"


@query(f"""WITH {CELLS}, k AS (SELECT test, sum(failed) / count(*) AS p, count(*) * 1.0 AS n, 1.96 AS z FROM cells GROUP BY 1) SELECT test, round(greatest(0, {WILSON.format('-')}), 6) AS low, round(least(1, {WILSON.format('+')}), 6) AS high FROM k""")
def wilson(t):
    k = M.cells(measure(t)).groupBy("test").agg(F.sum("failed").alias("k"), F.count("*").alias("n"))
    low, high = N.wilson(F.col("k"), F.col("n"))
    return k.select("test", r6(low, "low"), r6(high, "high"))


@query(f"WITH {CELLS} SELECT test, count(*) AS n, round(CASE WHEN sum(failed) = 0 THEN 3.0 / count(*) END, 6) AS bound FROM cells GROUP BY 1")
def rule_of_three(t):
    return M.cells(measure(t)).groupBy("test").agg(F.count("*").alias("n"), r6(F.when(F.sum("failed") == 0, 3.0 / F.count("*")), "bound"))


@query(f"""WITH {MEASURE}, z AS (SELECT dut, test, data, avg(data) OVER w AS m, stddev_samp(data) OVER w AS s FROM measure WINDOW w AS (PARTITION BY dut, test)) SELECT dut, test, count(*) AS n,
 round(CASE WHEN stddev_pop(data) > 0 THEN avg(pow(data - m, 3)) / pow(stddev_pop(data), 3) END, 5) AS skew FROM z GROUP BY 1, 2""")
def margin_skewness(t):
    rows = measure(t).groupBy("dut", "test").agg(F.count("*").alias("n"), F.stddev_pop("data").alias("s"), F.skewness("data").alias("k"))
    return rows.select("dut", "test", "n", F.round(F.when(F.col("s") > 0, F.col("k")), 5).alias("skew"))


def cusum_drift(t):
    """Largest one-sided downward sum of standardised values in order of report, slack 0.5."""
    rows = measure(t).groupBy("dut", "test").agg(F.array_sort(F.collect_list(F.struct("report", "seq", "data"))).alias("s"), F.avg("data").alias("m"), F.stddev_samp("data").alias("sd"))
    step = lambda acc, x: F.struct(F.least(F.lit(0.0), acc["s"] + (x["data"] - F.col("m")) / F.col("sd") + 0.5).alias("s"), F.least(acc["low"], F.least(F.lit(0.0), acc["s"] + (x["data"] - F.col("m")) / F.col("sd") + 0.5)).alias("low"))
    low = F.aggregate("s", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("low")), step, lambda acc: acc["low"])
    return rows.where("sd > 0").select("dut", "test", r6(low, "cusum"))


query()(cusum_drift)

PREDS = """preds AS (SELECT doc_id, CASE quality WHEN 1 THEN 'P' WHEN 0 THEN 'N' ELSE 'U' END AS label, (n_chars % 1000) / 1000.0 AS score FROM documents LEFT JOIN labels USING (doc_id))"""
SUMS = PREDS + """, m AS (SELECT count(*) FILTER (label = 'P') AS n_p, count(*) FILTER (label = 'N') AS n_n, count(*) FILTER (label = 'U') AS n_u, count(*) FILTER (label = 'P' AND score >= 0.4) AS tp, count(*) FILTER (label = 'N' AND score >= 0.4) AS fp,
 count(*) FILTER (label = 'U' AND score >= 0.4) AS fu FROM preds), r AS (SELECT *, coalesce(tp / n_p, 0) AS recall, coalesce(fu / n_u, 0) AS flag_rate, coalesce(fp / n_n, 0) AS fpr, coalesce(tp / (tp + fp), 0) AS precision FROM m)"""


def preds(t):
    label = F.when(F.col("quality") == 1, "P").when(F.col("quality") == 0, "N").otherwise("U")
    return t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left").select("doc_id", label.alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


@query(f"WITH {SUMS} SELECT n_p, n_n, n_u, round(recall, 6) AS recall, round(flag_rate, 6) AS flag_rate, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(recall * recall / ((tp + fp + fu) / (n_p + n_n + n_u)), 6) AS lee_liu FROM r")
def pu_metrics(t):
    m = C.pu_metrics(preds(t), 0.4)
    return m.select("n_p", "n_n", "n_u", *(r6(F.col(c), c) for c in ("recall", "flag_rate", "fpr", "precision", "lee_liu")))


@query(f"WITH {SUMS} SELECT CAST(p AS DOUBLE) AS prior, round(least(1, p * recall / flag_rate), 6) AS precision FROM r, (VALUES (0.01), (0.02), (0.05), (0.1), (0.2), (0.3)) v(p)")
def precision_sensitivity(t):
    return C.precision_sensitivity(C.pu_metrics(preds(t), 0.4), [0.01, 0.02, 0.05, 0.1, 0.2, 0.3]).select("prior", r6(F.col("precision"), "precision"))


@query(f"WITH {PREDS} SELECT round(least(0.999, quantile_cont(CAST(score AS DOUBLE), 0.05)), 6) AS threshold FROM preds WHERE label = 'P'")
def recall_threshold(t):
    return C.recall_threshold(preds(t), 0.95).select(r6(F.col("threshold"), "threshold"))


@query(f"""WITH {PREDS}, q AS (SELECT doc_id, least(greatest(CAST(score AS DOUBLE), 1e-6), 1 - 1e-6) AS p, CASE WHEN label = 'P' THEN 1.5 WHEN label = 'N' THEN -2.0 ELSE 0 END AS prior FROM preds) SELECT doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5 * prior))), 6) AS p FROM q""")
def prior_blend(t):
    prior = F.when(F.col("label") == "P", 1.5).when(F.col("label") == "N", -2.0).otherwise(0.0)
    return preds(t).select("doc_id", r6(C.blend_prior(F.col("score"), prior, 0.5), "p"))


EVIDENCE = [("(?i)license", 30.0), ("(?i)@mail", 25.0), ("[0-9]{16}", 45.0), ("(?i)worthless", -40.0)]


@query("""SELECT doc_id, CASE WHEN a OR b OR c OR d THEN least(100, greatest(0, (CASE WHEN a THEN 30.0 ELSE 0 END) + (CASE WHEN b THEN 25.0 ELSE 0 END) + (CASE WHEN c THEN 45.0 ELSE 0 END) - (CASE WHEN d THEN 40.0 ELSE 0 END)))::DOUBLE END AS score
 FROM (SELECT doc_id, regexp_matches(text, '(?i)license') AS a, regexp_matches(text, '(?i)@mail') AS b, regexp_matches(text, '[0-9]{16}') AS c, regexp_matches(text, '(?i)worthless') AS d FROM documents)""")
def space_score(t):
    return t("documents").select("doc_id", X.weighted_score(F.col("text"), EVIDENCE).alias("score"))


@query("""WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), s AS (SELECT source, count(DISTINCT doc_id) AS docs FROM l GROUP BY 1)
 SELECT source, line, count(*) AS n FROM l JOIN s USING (source) WHERE line <> '' AND length(line) <= 200 GROUP BY source, line, docs HAVING count(*) >= greatest(2, round_even(docs * 0.02, 0))""")
def boilerplate_lines(t):
    lines = t("documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", F.trim("line").alias("line"))
    return C.boilerplate(lines, 0.02, 2, 200)


@query("SELECT page_id, pos, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages))")
def html_links(t):
    return t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(t):
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z]+;", " ")
    return t("pages").select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(?:license|version|public)', ' ', 'g') AS text FROM documents")
def mask_text(t):
    return t("documents").select("doc_id", X.masked(F.col("text"), ["license", "version", "public"]).alias("text"))


@query("""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+\\.[0-9])[^0-9.]', 1), '') AS DOUBLE) AS value, nullif(regexp_extract(text, '(?i)(?:version|BY-NC)[ ,]*([0-9.]*[0-9])', 1), '') AS version FROM documents""")
def range_mining(t):
    pull = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return t("documents").select("doc_id", F.try_to_number(pull(r"([0-9]+\.[0-9])[^0-9.]"), F.lit("999999999999999.9")).cast("double").alias("value"), pull(r"(?i)(?:version|BY-NC)[ ,]*([0-9.]*[0-9])").alias("version"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT props) AS spellings FROM events GROUP BY 1")
def json_facts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.count_distinct("props").alias("spellings"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_field_survey(t):
    return t("events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN f < 1 THEN 1.1 WHEN f > 40 THEN 1.9 ELSE (CASE WHEN f <= 10 THEN 1.1 WHEN f <= 20 THEN 1.3 ELSE 1.9 END) END AS vswr FROM (SELECT o_orderkey, o_totalprice / 5000 AS f FROM orders)""")
def piecewise_lookup(t):
    """The first ascending band that holds the frequency; below the first, beyond the last held."""
    bands = t("region").sparkSession.createDataFrame([(1.0, 10.0, 1.1), (10.0, 20.0, 1.3), (20.0, 40.0, 1.9)], "lo double, hi double, vswr double")
    return U.piecewise(t("orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("f")), bands, "f", "vswr").select("o_orderkey", "vswr")


@query("""WITH k AS (SELECT i * 4.0 AS f, pow(i, 2) * 1.0 AS v FROM range(0, 14) x(i)), q AS (SELECT DISTINCT l_quantity AS f FROM lineitem) SELECT q.f, round(a.v + (b.v - a.v) * (q.f - a.f) / 4.0, 6) AS v FROM q JOIN k a ON a.f = floor(q.f / 4) * 4 JOIN k b ON b.f = a.f + 4""")
def interp_asof(t):
    """Linear interpolation between the samples below and above."""
    samples = t("region").sparkSession.range(0, 14).select(F.lit(0).alias("k"), (F.col("id") * 4.0).alias("f"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    asked = t("lineitem").select(F.lit(0).alias("k"), F.col("l_quantity").alias("f")).distinct()
    return U.interpolated(asked, samples, ["k"], "f", ["v"]).select("f", r6(F.col("v"), "v"))


@query("SELECT p_partkey AS part_id, round(0.1 + 0.002 * p_size + 0.03 * sqrt(p_size) + 3 * (0.01 + 0.001 * p_size + 0.02 * sqrt(p_size)), 6) AS loss_db, round(3 * 0.3048 / (0.7 * 299792458.0) * 1e9, 6) AS delay_ns FROM part")
def cable_loss(t):
    f, feet = F.col("p_size").cast("double"), F.lit(3.0)
    return t("part").select(F.col("p_partkey").alias("part_id"), r6(N.cable_loss_db(f, feet, (0.1, 0.002, 0.03), (0.01, 0.001, 0.02)), "loss_db"), r6(N.delay_s(feet, 0.7) * 1e9, "delay_ns"))


@query("SELECT p_partkey AS part_id, round(CASE WHEN v > 1e6 THEN v / 1e6 WHEN v > 300 THEN v / 1e3 ELSE v END, 9) AS ghz, CASE WHEN p_size > 0 THEN round_even(10 * log10(p_size * 1000.0), 1) END AS dbm FROM (SELECT *, p_retailprice AS v FROM part)")
def unit_inference(t):
    return t("part").select(F.col("p_partkey").alias("part_id"), F.round(N.inferred_ghz(F.col("p_retailprice")), 9).alias("ghz"), N.watts_to_dbm(F.col("p_size").cast("double")).alias("dbm"))


@query("SELECT p_partkey AS part_id, CASE WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'metal' WHEN regexp_matches(p_type, 'BRASS|COPPER|NICKEL') THEN 'alloy' ELSE 'other' END AS kind FROM part")
def first_rule_category(t):
    return t("part").select(F.col("p_partkey").alias("part_id"), X.first_rule(F.col("p_type"), [("STEEL|TIN", "metal"), ("BRASS|COPPER|NICKEL", "alloy")], "other").alias("kind"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    """Tumbling windows over events, the batch form of the streaming plan."""
    return t("events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, source, n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n <= 2")
def stratified_sample(t):
    at = Window.partitionBy("source", "lang").orderBy("n_chars", "doc_id")
    return t("documents").withColumn("n", F.row_number().over(at)).where("n <= 2").select("doc_id", "source", "n")
