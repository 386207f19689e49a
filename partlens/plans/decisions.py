"""Test redundancy and learning from positive and unlabeled texts over the dataset's stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.operators import measurements as M
from partlens.operators import pulearn as L
from partlens.operators import redundancy as R

from .registry import query, r6
from .search import split_fields

#: Few tests with many reports each: a supplier's digit is the test, an order the report.
ROWS = "l_returnflag AS dut, 'T' || (l_suppkey % 10) || ' - Gain (ch-' || (l_suppkey % 10) || ')' AS test, 'R' || (l_orderkey % 400) AS report, CASE WHEN l_tax > 0.01 THEN l_quantity END AS data, CASE WHEN l_suppkey % 10 <> 3 THEN -5.0 END AS lower, CASE WHEN l_suppkey % 10 <> 4 THEN 49.5 + (l_suppkey % 10) END AS upper, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq"
MEASURED = f"measured AS (SELECT {ROWS} FROM lineitem)"
CONFIG = R.Config(least_runs=10)


def measured(t):
    return t("lineitem").selectExpr(*split_fields(ROWS))


CELLS = MEASURED + """, cells AS (SELECT report, test, max(CASE WHEN data > upper OR data < lower THEN 1 ELSE 0 END) AS failed, avg(data) AS mean FROM measured GROUP BY 1, 2), owner AS (SELECT report, arg_min(dut, seq) AS dut FROM measured GROUP BY 1),
 lim AS (SELECT dut, test, max(upper) AS upper, min(lower) AS lower, stddev_samp(data) AS sd FROM measured GROUP BY 1, 2), whole AS (SELECT dut, report, test, failed, mean, upper, lower, sd FROM cells JOIN owner USING (report) JOIN lim USING (dut, test))"""


@query(f"WITH {CELLS} SELECT dut, test, count(*) AS n_good, CAST(sum(failed) AS BIGINT) AS fails, count(mean) AS n_values, round(avg(CASE WHEN mean IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM whole GROUP BY 1, 2")
def redundancy_counts(t):
    """Runs, failures and missing values of each dut's tests; no report is dead here."""
    judged = R.judged_cells(measured(t), R.Config(dead_least_tests=1000))
    return R.counts(judged).select("dut", "test", "n_good", F.col("fails_good").alias("fails"), F.col("values_good").alias("n_values"), r6(F.col("missing"), "missing"))


@query()
def redundancy_decisions(t):
    """The decision for each test; a loop over dense matrices stands for the SQL in the tests."""
    rows = R.decided(measured(t), CONFIG)
    return rows.select("dut", "test", "digit", "reason", "safe", "individual", "clustered", "candidate", r6(F.col("pooled_ub"), "pooled_ub"), r6(F.col("cohesion"), "cohesion"), r6(F.col("r2"), "r2"))


@query()
def redundancy_cut(t):
    """What goes and what stays so that every co-failure mode keeps two of its tests."""
    rows = measured(t)
    judged = R.judged_cells(rows, CONFIG)
    return R.cut(R.decided(rows, CONFIG), R.modes(judged, CONFIG), CONFIG).select("dut", "test", "candidate", "removed", "kept_for_coverage")


@query(f"WITH {MEASURED}, x AS (SELECT DISTINCT dut, test, substr(test, 2, 1) AS digit FROM measured) SELECT dut, test, round(CASE WHEN dut = 'A' AND digit = '1' THEN 120.0 / count(*) OVER (PARTITION BY dut, digit) ELSE 60.0 / (SELECT count(DISTINCT test) FROM measured) END, 6) AS seconds FROM x")
def test_durations(t):
    return R.durations(measured(t), {("A", "1"): 2.0}).select("dut", "test", r6(F.col("seconds"), "seconds"))


@query(f"""WITH {MEASURED}, v AS (SELECT DISTINCT dut AS g, CAST(substr(test, 2, 1) AS DOUBLE) AS v FROM measured WHERE data > 20 OR substr(test, 2, 1) IN ('1', '2', '7')), r AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM (SELECT DISTINCT v FROM v))
 SELECT g AS "group", 'ch' AS key, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT g, v, n - row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM v JOIN r USING (v)) GROUP BY g, i HAVING count(*) >= 2""")
def parameter_ranges(t):
    rows = measured(t).where("data > 20 OR substr(test, 2, 1) IN ('1', '2', '7')")
    return R.ranges(rows.select(F.col("dut").alias("group"), "test").distinct())


@query(f"WITH {MEASURED} SELECT DISTINCT dut AS \"group\", 'Gain' AS tokens FROM measured WHERE dut IN (SELECT dut FROM measured GROUP BY 1 HAVING count(DISTINCT test) > 1)")
def shared_tokens(t):
    rows = R.shared_tokens(measured(t).select(F.col("dut").alias("group"), "test").distinct())
    return rows.select("group", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {MEASURED} SELECT dut, test, count(*) AS n FROM measured WHERE dut IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT report) >= 1")
def measured_pairs(t):
    return M.pair_stats(measured(t)).select("dut", "test").join(measured(t).groupBy("dut", "test").agg(F.count("*").alias("n")), ["dut", "test"])


def texts(t):
    label = F.when(F.col("quality") == 1, "P").when(F.col("quality") == 0, "N").otherwise("U")
    return t("documents").select("doc_id", "text").join(t("labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "text", label.alias("label"))


@query()
def pu_predictions(t):
    """Held-out and out-of-bag scores of all documents, from two bags in two folds."""
    preds, _ = L.train(texts(t), bags=2, folds=2, most=2000)
    return preds.select("id", "label", r6(F.col("score"), "score"), "qualifiable")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 3.0 ELSE 1.0 END AS weight FROM documents")
def negative_weights(t):
    said = F.when(F.contains(F.lower("text"), F.lit("license")), "an octal buffer").otherwise("a mixer")
    return t("documents").select("doc_id", L.negative_weight(said).alias("weight"))


@query("""WITH p AS (SELECT doc_id, CASE quality WHEN 1 THEN 'P' WHEN 0 THEN 'N' ELSE 'U' END AS label, (n_chars % 1000) / 1000.0 AS score FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, label FROM p WHERE label <> 'P' AND score >= 0.4 ORDER BY score DESC, doc_id LIMIT 30""")
def review_queue(t):
    label = F.when(F.col("quality") == 1, "P").when(F.col("quality") == 0, "N").otherwise("U")
    preds = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), label.alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return L.review_queue(preds.withColumn("qualifiable", F.col("score") >= 0.4), 30).select(F.col("id").alias("doc_id"), "label")


@query("SELECT count(*) AS judged, count(*) FILTER (quality = 1) AS \"right\", round(count(*) FILTER (quality = 1) / count(*), 6) AS precision, round(500.0 * count(*) FILTER (quality = 1) / count(*), 6) AS finds FROM labels")
def reviewed_precision(t):
    rows = t("labels").select(F.when(F.col("quality") == 1, "Yes").otherwise("n").alias("verdict"))
    return L.reviewed(rows, 500, 0.9).select("judged", "right", r6(F.col("precision"), "precision"), r6(F.col("finds"), "finds"))

