"""What several operators share: the word rule, shared storage, tokens by word cache."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are ASCII digits, ASCII letters or beyond ASCII (before lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is (lower() would also change letters beyond ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The lower-cased words of a text; null counts as empty. What separates words is split off, which is far quicker than finding words."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP + "+"), "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda function Spark would compute it anew at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that are combined one after the other; appending to an array copies it, so longer arrays are taken in blocks.
RUN = 64


def running(values: Column, kind: str, combine) -> Column:
    """For each element of an array its combination with all before it; `combine` has to be associative. About linear in the size."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.lit(None).cast(kind)

    def run(block: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            now = F.when(acc["last"].isNull(), v).otherwise(combine(acc["last"], v))
            return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(block, F.struct(nothing.alias("last"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(own: Column) -> Column:
        ends = run(F.transform(own, lambda o: F.element_at(o, -1)))
        return let(ends, lambda e: F.flatten(F.transform(own, lambda o, i: F.when(i == 0, o).otherwise(F.transform(o, lambda v: combine(F.get(e, i - 1), v))))))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, RUN))
        return let(F.transform(cut, run), joined)

    return let(values, lambda v: F.when(F.size(v) <= RUN, run(v)).otherwise(blocks(v)))


def before(totals: Column, i: Column, zero: int = 0) -> Column:
    """What a running combination was before place i."""
    return F.when(i == 0, F.lit(zero)).otherwise(F.get(totals, i - 1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, gets one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='partlens-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/partlens-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Bytes of a block of the tables between steps.
BLOCK = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", BLOCK).parquet(path)  # a task holds a block until it is full
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """Rows go to Python workers in batches of at most so many: for long texts and records, whose batches are held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before_ = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before_)) if int(before_) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before_)


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more: rounds of an iteration leave one table."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
