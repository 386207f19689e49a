"""The registered queries of the operators: each applies one to its whole table and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html, licenses, neardup, neighbours, ordering, packing, pii, toxicity, urls
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def pii_digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, pii.NAMES))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    of_kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [of_kind(n).alias(f"n_{kind}") for n, (kind, _, _) in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(pii.find(_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def license_digest(found: DataFrame) -> DataFrame:
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    every = F.array_union(base, F.transform("found", lambda d: d["label"]))
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(licenses.detect(_table(spark, sf_dir, "documents")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).drop("patterns")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and reads every record back from them."""
    path = shared_path(spark, "shards")
    ordering.write_shards(_table(spark, sf_dir, "documents"), path)
    found = ordering.read_slots(spark, path)
    return found.select("slot", "shard", "byte_offset", F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"), "n_tokens", F.crc32("input_ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_personal_data": op2_personal_data,
    "op3_toxicity": op3_toxicity,
    "op4_license_scans": op4_license_scans,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_html_extraction": op8_html_extraction,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_training_order": op10_training_order,
}
ORACLE_SQL: dict[str, str] = {"op7_url_filters": urls.oracle()}
