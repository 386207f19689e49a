"""Which tests could be left out: statistics, clusters, co-failure modes and a cut that keeps every mode covered.

rows(dut, test, report, data, lower, upper, seq): one measurement each, seq the order of recording. A column of the analysis is a
dut and a test; a report belongs to the dut of its first row. Everything stays long; only a test's history, a cluster's
reports and the modes that share tests are gathered, each in a task of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import parsing as P
from partlens.functions import statistics as stats
from partlens.session import written

from . import clusters, measurements


@dataclass(frozen=True)
class Config:
    """Thresholds of the decisions."""

    coverage: float = 0.7
    confidence: float = 0.95
    escape_budget: float = 0.05
    cluster_escape_budget: float = 0.05
    dead_floor: float = 0.30
    dead_least_tests: int = 10
    dead_least_reports: int = 5
    skew_limit: float = 1.0
    skew_least: int = 30
    drift_least: int = 20
    least_cluster: int = 3
    safe_majority: float = 0.40
    least_runs: int = 30
    bad_values: float = 0.20
    keep: int = 2
    mode_reports: int = 2
    mode_similarity: float = 0.50
    mode_merge: float = 0.70
    mode_most: int = 150
    token_cut: float = 0.60
    cohesion: float = 0.30
    explained: float = 0.75
    pooled_least: int = 5


#: The same analysis at three degrees of caution.
PROFILES = [
    Config(coverage=0.80, confidence=0.90, escape_budget=0.020, cluster_escape_budget=0.030, safe_majority=0.50, explained=0.70, least_runs=20, least_cluster=2, token_cut=0.70, mode_similarity=0.40),
    Config(coverage=0.90, confidence=0.95, escape_budget=0.010, cluster_escape_budget=0.015, safe_majority=0.60, explained=0.80, least_runs=25, least_cluster=3, token_cut=0.60, mode_similarity=0.50),
    Config(coverage=0.95, confidence=0.95, escape_budget=0.005, cluster_escape_budget=0.008, safe_majority=0.70, explained=0.90, least_runs=30, least_cluster=3, token_cut=0.50, mode_similarity=0.60),
]


def cells(rows: DataFrame) -> DataFrame:
    """report, dut, test, failed, mean, at (where the report begins): row limits decide failures, the report's dut is its first row's."""
    own = rows.groupBy("report").agg(F.min_by("dut", "seq").alias("dut"), F.min("seq").alias("at"))
    out = rows.groupBy("report", "test").agg(F.max(measurements.failing(rows).cast("int")).alias("failed"), F.avg("data").alias("mean"))
    return out.join(own, "report")


def judged_cells(rows: DataFrame, config: Config) -> DataFrame:
    """The cells with their margin against the pooled limits and whether their report is dead."""
    pairs = measurements.pair_stats(rows).select("dut", "test", "lower", "upper", "sd")
    dead = measurements.dead_reports(cells(rows).select("report", "test", "failed"), config.dead_least_tests, config.dead_least_reports, config.dead_floor).select("report", "dead")
    out = cells(rows).join(pairs, ["dut", "test"]).join(dead, "report", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    return out.withColumn("margin", N.margin(F.col("mean"), F.col("lower"), F.col("upper"), F.col("sd")))


def histories(judged: DataFrame, config: Config) -> DataFrame:
    """dut, test, p_gpd, drift, low_margin, skew: what needs a test's margins of good reports in order of the reports."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable")
        x, m = part["mean"].to_numpy(float), part["margin"].to_numpy(float)
        x, m = x[~np.isnan(x)], m[~np.isnan(m)]
        spread = x.std()
        skew = float(((x - x.mean()) ** 3).mean() / spread**3) if len(x) and spread > 0 else math.nan
        drift = len(x) >= config.drift_least and len(m) > 0 and stats.drifts(m)
        row = {"dut": part["dut"].iloc[0], "test": part["test"].iloc[0], "p_gpd": stats.tail_probability(m), "drift": drift, "low_margin": stats.hazen_quantile(m, 1 - config.coverage), "skew": skew}
        return pd.DataFrame([row])

    kinds = dict(judged.dtypes)
    good = judged.where("NOT dead").select("dut", "test", "at", "mean", "margin")
    out = good.groupBy("dut", "test").applyInPandas(run, f"dut {kinds['dut']}, test {kinds['test']}, p_gpd double, drift boolean, low_margin double, skew double")
    return out.select("dut", "test", F.nanvl("p_gpd", F.lit(None)).alias("p_gpd"), "drift", F.nanvl("low_margin", F.lit(None)).alias("low_margin"), F.nanvl("skew", F.lit(None)).alias("skew"))


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by the continued fraction of its tail and the series about 0 (absolute error below 1e-7)."""
    size = F.abs(z)
    t = 1 / (1 + 0.2316419 * size)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-size * size / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def tail_probability(mean: Column, sd: Column, lower: Column, upper: Column, empirical: Column, tail: Column) -> Column:
    """The greatest of three estimates of a failure: normal beyond either limit, observed, and the fitted tail."""
    beyond = F.coalesce(normal_below(-(upper - mean) / sd), F.lit(0.0)) + F.coalesce(normal_below(-(mean - lower) / sd), F.lit(0.0))
    outside = F.coalesce(mean > upper, F.lit(False)) | F.coalesce(mean < lower, F.lit(False))
    normal = F.when(sd > 0, beyond).otherwise(F.when(outside, 1.0).otherwise(0.0))
    return F.greatest(normal, F.coalesce(empirical, F.lit(0.0)), F.coalesce(tail, F.lit(0.0)), F.lit(0.0))


def counts(judged: DataFrame) -> DataFrame:
    """dut, test: runs and failures of good and of dead reports, values of good ones, the share of runs without a value, the share beyond the limits."""
    good = ~F.col("dead")
    outside = F.coalesce(F.col("mean") > F.col("upper"), F.lit(False)) | F.coalesce(F.col("mean") < F.col("lower"), F.lit(False))
    return judged.groupBy("dut", "test").agg(
        F.count_if(good).alias("n_good"), F.count_if(good & (F.col("failed") == 1)).alias("fails_good"), F.count_if(~good & (F.col("failed") == 1)).alias("fails_dead"),
        F.count_if(good & F.col("mean").isNotNull()).alias("values_good"), F.avg(F.col("mean").isNull().cast("int")).alias("missing"),
        F.avg(F.when(good & F.col("mean").isNotNull(), outside.cast("int"))).alias("p_emp"),
    )


def named(rows: DataFrame, config: Config) -> DataFrame:
    """dut, test, digit, cluster: tests of a digit group whose names share tokens."""
    tests = rows.select("dut", "test").distinct().withColumn("name", F.col("test").cast("string"))
    tests = tests.withColumn("digit", P.digit_group(F.col("name"))).withColumn("tokens", P.name_tokens(F.col("name")))
    own = F.concat_ws("\x1f", F.col("dut").cast("string"), "name")
    found = clusters.token_clusters(tests.select(F.col("digit").alias("block"), own.alias("test"), "tokens"), config.token_cut).withColumnsRenamed({"test": "own", "block": "digit"})
    return tests.withColumn("own", own).join(found, ["digit", "own"]).select("dut", "test", "digit", F.concat_ws(":", "digit", F.col("cluster").cast("string")).alias("cluster"))


def grouped(judged: DataFrame, names: DataFrame, config: Config) -> DataFrame:
    """dut, test, cluster, members, cohesion, r2, pooled_ub: what needs a cluster's reports side by side."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = part[["dut", "test"]].drop_duplicates().sort_values(["dut", "test"], ignore_index=True)
        at = {key: i for i, key in enumerate(keys.itertuples(index=False, name=None))}
        column = np.array([at[key] for key in zip(part["dut"], part["test"], strict=True)])
        good = ~part["dead"].to_numpy(bool)
        reports, row = np.unique(part["report"].to_numpy()[good], return_inverse=True)
        margin, failed = np.full((len(reports), len(keys)), np.nan), np.zeros((len(reports), len(keys)))
        margin[row, column[good]] = part["margin"].to_numpy(float)[good]
        failed[row, column[good]] = part["failed"].to_numpy(float)[good]
        runs, fails = np.bincount(column[good], minlength=len(keys)), np.bincount(column[good], part["failed"].to_numpy(float)[good], len(keys))
        alone = len(keys) < 2
        keys["cohesion"] = 1.0 if alone else stats.mean_abs_correlation(margin)
        keys["r2"] = 0.0 if alone else [stats.predict_r2(margin, i) for i in range(len(keys))]
        bound = stats.pooled_bounds(fails, runs, failed, config.pooled_least, config.confidence)
        keys["pooled_ub"] = np.where(np.isnan(bound) & (runs > 0), 3 / np.maximum(runs, 1), bound)
        return keys.assign(cluster=part["cluster"].iloc[0], members=len(keys))[["dut", "test", "cluster", "members", "cohesion", "r2", "pooled_ub"]]

    kinds = dict(judged.dtypes)
    rows = judged.join(names.select("dut", "test", "cluster"), ["dut", "test"]).select("cluster", "report", "dut", "test", "margin", "failed", "dead")
    out = rows.groupBy("cluster").applyInPandas(run, f"dut {kinds['dut']}, test {kinds['test']}, cluster string, members long, cohesion double, r2 double, pooled_ub double")
    return out.withColumn("pooled_ub", F.nanvl("pooled_ub", F.lit(None)))


def durations(rows: DataFrame, block_minutes: dict[tuple[str, str], float] = {}, total_minutes: float = 1.0) -> DataFrame:
    """dut, test, seconds: a measured time of a dut's digit group is shared by its tests; without one all tests share the whole time alike."""
    tests = rows.select("dut", "test").distinct().withColumn("digit", P.digit_group(F.col("test").cast("string")))
    tests = tests.withColumn("own", F.count("*").over(Window.partitionBy("dut", "digit")))
    every = rows.agg(F.count_distinct("test").alias("every"))
    table = F.create_map(*(F.lit(x) for (dut, digit), minutes in block_minutes.items() for x in (f"{dut}\x1f{digit}", float(minutes)))) if block_minutes else None
    known = F.try_element_at(table, F.concat_ws("\x1f", F.col("dut").cast("string"), "digit")) if block_minutes else F.lit(None).cast("double")
    return tests.crossJoin(F.broadcast(every)).select("dut", "test", "digit", F.coalesce(known * 60 / F.col("own"), total_minutes * 60 / F.greatest("every", F.lit(1))).alias("seconds"))


def decided(rows: DataFrame, config: Config = Config(), block_minutes: dict[tuple[str, str], float] = {}) -> DataFrame:
    """One row for each dut and test: statistics, why it is or isn't safe, whether it is redundant by itself or with its cluster."""
    judged = written(judged_cells(rows, config), "cells")
    names = named(rows, config)
    of = ["dut", "test"]
    out = measurements.pair_stats(rows).join(counts(judged), of).join(histories(judged, config), of, "left").join(names, of).join(grouped(judged, names, config).drop("cluster"), of).join(durations(rows, block_minutes).drop("digit"), of)
    n, limits = F.col("values_good"), F.col("lower").isNotNull() | F.col("upper").isNotNull()
    out = out.withColumn("scorable", (F.col("n") > 0) & limits).withColumn("parse_ok", F.col("missing") <= config.bad_values)
    tail = tail_probability(F.col("mean"), F.col("sd"), F.col("lower"), F.col("upper"), F.col("p_emp"), F.col("p_gpd"))
    bound = F.when(n < 1, 1.0).when(F.col("fails_good") == 0, 3 / n).otherwise(N.wilson_upper(F.col("fails_good"), n))
    enough = math.ceil(math.log(1 - config.confidence) / math.log(config.coverage))
    skewed = (n >= config.skew_least) & (F.abs("skew") > config.skew_limit) & (n < enough)
    conformal = F.coalesce((n >= 2) & (F.col("low_margin") > 0) & ~F.coalesce(skewed, F.lit(False)), F.lit(False))
    out = out.withColumn("p_tail", F.when(F.col("scorable"), tail)).withColumn("fail_ub", F.when(F.col("scorable"), bound)).withColumn("conformal", F.col("scorable") & conformal)
    out = out.withColumn("drift", F.col("scorable") & F.coalesce("drift", F.lit(False)))
    reason = F.when(F.col("n") == 0, "no numeric data").when(~limits, "no pass/fail limits").when(F.col("fails_good") > 0, "fails good units").when(F.col("drift"), "drift toward limit").when(~F.col("conformal"), "margin near limit").otherwise("safe margin, no fails")
    out = out.withColumn("reason", reason).withColumn("safe", F.col("conformal") & ~F.col("drift") & F.coalesce(F.col("p_tail") < config.escape_budget, F.lit(False)))
    clean = F.col("scorable") & F.col("parse_ok") & (F.col("fails_good") == 0)
    out = out.withColumn("individual", F.coalesce(clean & F.col("safe") & (F.col("n_good") >= config.least_runs) & (F.col("pooled_ub") < config.escape_budget), F.lit(False)))
    of_cluster = Window.partitionBy("cluster")
    safe_share = F.avg(F.when(F.col("scorable"), F.col("safe").cast("int"))).over(of_cluster)
    first_bound = F.min_by("pooled_ub", F.struct("dut", "test")).over(of_cluster)
    gate = (F.col("members") >= config.least_cluster) & (safe_share >= config.safe_majority) & (F.sum("fails_good").over(of_cluster) == 0) & (F.col("cohesion") >= config.cohesion) & (first_bound < config.cluster_escape_budget)
    out = out.withColumn("clustered", F.coalesce(gate & clean & (F.col("safe") | (F.col("r2") >= config.explained)), F.lit(False)))
    cut = (F.col("individual") | F.col("clustered")) & F.col("parse_ok") & ~F.col("drift") & (F.col("fails_good") + F.col("fails_dead") == 0)
    return out.withColumn("candidate", cut)


def least_linked(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node that each is connected with; the least label spreads a step a round, tables are written between."""
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        grown = written(labels.join(seen, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")), "labels")
        if grown.where("moved").isEmpty():
            return grown.select("node", "root")
        labels = grown.drop("moved")


def modes(judged: DataFrame, config: Config = Config()) -> DataFrame:
    """root, mode, own (dut and test): overlapping groups of tests that fail together; groups inside or much like a larger one are dropped.

    Groups that share no test don't meet, so each connected part is worked on by itself.
    """
    own = F.concat_ws("\x1f", F.col("dut").cast("string"), F.col("test").cast("string"))
    cell = written(judged.select("report", own.alias("test"), "failed"), "cells")
    pairs = written(measurements.cofailures(cell, config.mode_reports, config.mode_similarity).select("a", "b"), "pairs")
    roots = least_linked(pairs)
    groups = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("others"))
    groups = groups.join(roots, groups["a"] == roots["node"]).select("root", F.array_sort(F.array_union(F.array("a"), "others")).alias("members"), "a")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept = stats.distinct_modes([set(x) for x in part.sort_values("a")["members"]], config.mode_merge)
        kept = [sorted(g) for g in kept if len(g) <= config.mode_most]
        return pd.DataFrame([(part["root"].iloc[0], i, t) for i, g in enumerate(kept) for t in g], columns=["root", "mode", "own"])

    found = groups.groupBy("root").applyInPandas(run, "root string, mode long, own string")
    fails = cell.where("failed = 1").select(F.col("test").alias("own"), "report")
    enough = found.join(fails, "own").groupBy("root", "mode").agg(F.count_distinct("report").alias("reports")).where(F.col("reports") >= config.mode_reports)
    return found.join(enough.drop("reports"), ["root", "mode"])


def cut(tests: DataFrame, found: DataFrame, config: Config = Config()) -> DataFrame:
    """tests with removed and kept_for_coverage: candidates go unless a mode would keep too few of its members."""
    own = F.concat_ws("\x1f", F.col("dut").cast("string"), F.col("test").cast("string"))
    members = found.join(tests.select(own.alias("own"), "candidate", "seconds"), "own")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mode", "own"])
        tests_ = part.drop_duplicates("own")
        cost = {o: None if pd.isna(s) else float(s) for o, s in zip(tests_["own"], tests_["seconds"], strict=True)}
        removed, kept = stats.greedy_cut([list(g["own"]) for _, g in part.groupby("mode", sort=True)], set(tests_.loc[tests_["candidate"].astype(bool), "own"]), cost, config.keep)
        return pd.DataFrame([(o, o in removed, o in kept) for o in tests_["own"]], columns=["own", "goes", "stays"])

    settled = members.groupBy("root").applyInPandas(run, "own string, goes boolean, stays boolean")
    out = tests.withColumn("own", own).join(settled, "own", "left")
    return out.withColumn("removed", F.coalesce("goes", "candidate")).withColumn("kept_for_coverage", F.coalesce("stays", F.lit(False))).drop("own", "goes", "stays")


def escapes(judged: DataFrame, tests: DataFrame) -> DataFrame:
    """escapes: failing reports that no remaining test would have caught."""
    fails = judged.where("failed = 1").join(tests.select("dut", "test", "removed"), ["dut", "test"])
    caught = fails.groupBy("report").agg(F.bool_and("removed").alias("lost"))
    return caught.agg(F.count_if("lost").alias("escapes"))


def ranges(members: DataFrame) -> DataFrame:
    """members(group, test) -> group, key, lo, hi, n: runs of neighbouring parameter values that a group's test names cover.

    The neighbours of a value are those that any of the tests' names has for the same key.
    """
    spec = P.spec_of(F.col("test").cast("string"))
    values = members.select("group", F.explode(spec["values"]).alias("key", "v")).select("group", "key", F.col("v").try_cast("double").alias("v")).where("v IS NOT NULL").distinct()
    return measurements.islands(values, "group", "v", "key")


def shared_tokens(members: DataFrame) -> DataFrame:
    """members(group, test) -> group, tokens: those that all of the group's test names have."""
    tokens = members.select("group", "test", F.explode(P.name_tokens(F.col("test").cast("string"))).alias("token"))
    sizes = members.groupBy("group").agg(F.count_distinct("test").alias("tests"))
    all_of = tokens.groupBy("group", "token").agg(F.count_distinct("test").alias("n")).join(sizes, "group").where("n = tests")
    return all_of.groupBy("group").agg(F.array_sort(F.collect_list("token")).alias("tokens"))


def digit_groups(tests: DataFrame) -> DataFrame:
    """digit, tests, removed, percent, never_failed, all_redundant, seconds: the cut by digit group."""
    never = (F.col("fails_good") + F.col("fails_dead")) == 0
    out = tests.groupBy("digit").agg(F.count("*").alias("tests"), F.count_if("removed").alias("removed"), F.bool_and(never).alias("never_failed"), F.bool_and(F.col("individual") | F.col("clustered")).alias("all_redundant"), F.sum(F.when(F.col("removed"), F.col("seconds")).otherwise(0.0)).alias("seconds"))
    return out.withColumn("percent", 100.0 * F.col("removed") / F.col("tests"))


def analysed(rows: DataFrame, config: Config = Config(), block_minutes: dict[tuple[str, str], float] = {}) -> dict[str, DataFrame]:
    """All tables of the analysis: tests, modes, digit groups, key tests, escapes, parameter ranges of clusters."""
    judged = written(judged_cells(rows, config), "cells")
    tests = written(decided(rows, config, block_minutes), "tests")
    found = written(modes(judged, config), "modes")
    cut_tests = written(cut(tests, found, config), "cut")
    keys = measurements.key_tests(judged.select("report", F.concat_ws("\x1f", F.col("dut").cast("string"), F.col("test").cast("string")).alias("test"), "failed"))
    return {
        "tests": cut_tests, "modes": found, "digit_groups": digit_groups(cut_tests), "key_tests": keys.orderBy(F.desc("sole"), F.desc("fail_reports"), "test"),
        "escapes": escapes(judged, cut_tests), "ranges": ranges(cut_tests.select(F.col("cluster").alias("group"), "test")), "tokens": shared_tokens(cut_tests.select(F.col("cluster").alias("group"), "test")),
    }


def written_out(tables: dict[str, DataFrame], path: str) -> None:
    """Each table that has rows as a CSV folder with a header."""
    for name, table in tables.items():
        flat = table.select(*(F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in table.dtypes))
        if not flat.isEmpty():
            flat.write.mode("overwrite").csv(f"{path}/{name}", header=True)
