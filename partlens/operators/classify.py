"""Positive-unlabeled evaluation: metrics, sensitivity, thresholds, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.numbers import logit, sigmoid


def pu_metrics(preds: DataFrame, threshold: float) -> DataFrame:
    """preds(label P/N/U, score): recall on P, flag rate on U, Lee-Liu score, precision on labelled, false positives on N."""
    flagged = F.col("score") >= threshold
    count = lambda test: F.count_if(test)
    p, n, u = (F.col("label") == x for x in "PNU")
    sums = preds.agg(count(p).alias("n_p"), count(n).alias("n_n"), count(u).alias("n_u"), count(p & flagged).alias("tp"), count(n & flagged).alias("fp"), count(u & flagged).alias("fu"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rates = sums.withColumn("recall", share("tp", "n_p")).withColumn("flag_rate", share("fu", "n_u")).withColumn("fpr", share("fp", "n_n"))
    all_flagged = F.try_divide(F.col("tp") + F.col("fp") + F.col("fu"), F.col("n_p") + F.col("n_n") + F.col("n_u"))
    return rates.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("lee_liu", F.coalesce(F.try_divide(F.col("recall") ** 2, all_flagged), F.lit(0.0)))


def precision_sensitivity(metrics: DataFrame, priors: list[float]) -> DataFrame:
    """Precision on the unlabeled under assumed shares of hidden positives."""
    rows = metrics.select("recall", "flag_rate", F.explode(F.array(*map(F.lit, priors))).alias("prior"))
    return rows.select("prior", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("prior") * F.col("recall"), F.col("flag_rate")), F.lit(0.0))).alias("precision"))


def recall_threshold(scores: DataFrame, target: float) -> DataFrame:
    """The score that a share `target` of the positives reaches; 0.5 without any."""
    return scores.where("label = 'P'").agg(F.least(F.lit(0.999), F.coalesce(F.percentile("score", 1 - target), F.lit(0.5))).alias("threshold"))


def blend_prior(p: Column, prior: Column, weight: float) -> Column:
    return sigmoid(logit(p) + weight * prior)


def boilerplate(lines: DataFrame, share: float, least: int, longest: int) -> DataFrame:
    """lines(source, doc_id, line): trimmed lines that stand in at least max(least, share of the source's documents)."""
    sizes = lines.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    counts = lines.where((F.col("line") != "") & (F.char_length("line") <= longest)).select("source", "doc_id", "line").distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(sizes), "source").where(F.col("n") >= F.greatest(F.lit(least), F.bround(F.col("docs") * share))).select("source", "line", "n")
