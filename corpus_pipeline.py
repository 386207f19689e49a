"""From raw documents to packed training sequences, each stage written as Parquet and read by the next.

All stages but the last return the columns of documents and keep what they don't reject or change:
toxicity drops documents that the classifier chain calls toxic; near_duplicates keeps one document of each class;
decontamination drops documents that hold a window of a benchmark item; personal_data masks identifiers in the
texts; packing turns what is left into windows of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import decontamination, neardup, packing, pii, toxicity
from partlens.llm.common import written


#: Rows that go to a Python worker at a time: whole texts, so a batch is held several times over on either side.
BATCH = 2_000


def _small_batches(spark: SparkSession) -> None:
    """Stages are written after they return, so the session keeps the setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return neardup.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return pii.mask(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("input_ids"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("personal_data", _personal_data),
    ("packing", _packing),
]
#: The toxicity models are fitted, so SQL can't express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
