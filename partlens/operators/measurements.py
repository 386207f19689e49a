"""Test-redundancy analysis over long measurement rows (dut, test, report, data, lower, upper, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions.numbers import cpk


def pair_stats(rows: DataFrame) -> DataFrame:
    """Per dut and test: n, mean, sample deviation, pooled limits, Cpk."""
    out = rows.groupBy("dut", "test").agg(F.count("data").alias("n"), F.avg("data").alias("mean"), F.stddev_samp("data").alias("sd"), F.max("upper").alias("upper"), F.min("lower").alias("lower"))
    return out.withColumn("cpk", cpk(F.col("mean"), F.col("sd"), F.col("lower"), F.col("upper")))


def failing(rows: DataFrame) -> Column:
    """Outside the row's own limits; a missing limit or value never fails."""
    return F.coalesce(F.col("data") > F.col("upper"), F.lit(False)) | F.coalesce(F.col("data") < F.col("lower"), F.lit(False))


def cells(rows: DataFrame) -> DataFrame:
    """report, test: present, failed, mean. Kept long, never a dense matrix."""
    return rows.groupBy("report", "test").agg(F.max(failing(rows).cast("int")).alias("failed"), F.avg("data").alias("mean"))


def dead_reports(cells_: DataFrame, least_tests: int, least_reports: int, floor: float = 0.30) -> DataFrame:
    """Reports whose share of failures is above max(floor, median + 3 x 1.4826 x MAD) over reports with enough tests."""
    share = cells_.groupBy("report").agg(F.count("*").alias("tests"), F.avg("failed").alias("share"))
    enough = share.where(F.col("tests") >= least_tests)
    middle = enough.agg(F.median("share").alias("mid"), F.count("*").alias("reports"))
    spread = enough.crossJoin(F.broadcast(middle)).groupBy("mid", "reports").agg(F.median(F.abs(F.col("share") - F.col("mid"))).alias("mad"))
    limit = F.greatest(F.lit(floor), F.col("mid") + 3 * 1.4826 * F.col("mad"))
    judged = enough.crossJoin(F.broadcast(spread)).withColumn("dead", (F.col("reports") >= least_reports) & (F.col("share") > limit))
    return judged.select("report", "tests", "share", "dead")


def cofailures(cells_: DataFrame, least_joint: int = 2, similarity: float = 0.5) -> DataFrame:
    """Pairs of tests that fail together: Jaccard of failing reports where both were run.

    Presence is counted only for pairs that fail together often enough.
    """
    fails = cells_.where("failed = 1").select("report", "test")
    a, b = fails.select("report", F.col("test").alias("a")), fails.select("report", F.col("test").alias("b"))
    joint = a.join(b, "report").where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint")).where(F.col("joint") >= least_joint)
    both = joint.select("a", "b").union(joint.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = cells_.select("report", F.col("test").alias("b"))
    here = a.join(both, "a").join(seen, ["report", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    out = joint.join(here.withColumnRenamed("n", "na"), ["a", "b"]).join(here.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("nb")), ["a", "b"])
    out = out.withColumn("similarity", F.col("joint") / (F.col("na") + F.col("nb") - F.col("joint")))
    return out.where(F.col("similarity") >= similarity).select("a", "b", "joint", "similarity")


def key_tests(cells_: DataFrame) -> DataFrame:
    """Per test: failing reports, and those that only it catches."""
    fails = cells_.where("failed = 1").withColumn("others", F.count("*").over(Window.partitionBy("report")) - 1)
    return fails.groupBy("test").agg(F.count("*").alias("fail_reports"), F.sum((F.col("others") == 0).cast("long")).alias("sole"))


def occurrence_reports(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The k-th time a dut meets a test is its k-th report."""
    k = F.row_number().over(Window.partitionBy("dut", "test").orderBy(*order))
    return rows.withColumn("report_no", k).withColumn("report", F.concat(F.col("dut").cast("string"), F.lit("_R"), F.lpad(k.cast("string"), 6, "0")))


def time_reports(rows: DataFrame, least_gap: float, factor: float) -> DataFrame:
    """A new report of a dut after a gap above max(least_gap, factor x max(median gap, 1))."""
    order = Window.partitionBy("dut").orderBy("ts", "seq")
    gaps = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(order))
    usual = gaps.groupBy("dut").agg(F.median("gap").alias("usual"))
    limit = F.greatest(F.lit(float(least_gap)), F.lit(float(factor)) * F.greatest(F.coalesce(F.col("usual"), F.lit(1.0)), F.lit(1.0)))
    opened = gaps.join(usual, "dut").withColumn("opens", (F.col("gap").isNull() | (F.col("gap") > limit)).cast("int"))
    return opened.withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, group: str, value: str, key: str | None = None) -> DataFrame:
    """Runs of at least two neighbouring values that a group covers; neighbours are among all values, of the same key if there are keys.

    Without a key the values are ranked by one window over the distinct ones, which are few by nature (settings of a parameter).
    """
    keys = [key] if key else []
    ranked = Window.partitionBy(*keys).orderBy(value) if keys else Window.orderBy(value)
    every = rows.select(*keys, value).distinct().withColumn("_rank", F.row_number().over(ranked))
    own = rows.select(group, *keys, value).distinct().join(every, [*keys, value])
    own = own.withColumn("_island", F.col("_rank") - F.row_number().over(Window.partitionBy(group, *keys).orderBy(value)))
    return own.groupBy(group, *keys, "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).where("n >= 2").drop("_island")
