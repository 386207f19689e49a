"""Training-order materialisation: every sequence gets a global slot by a keyed permutation and lies in a fixed-stride shard.

1. Each input partition strings its documents' ids (an end id after each) into sequences of `length` ids; only
   the partition's last one is padded. Sequences are written once to shared storage with their partition and place.
2. Sequences are counted by partition, so each has a number from 0 to N - 1: those of earlier partitions and its place.
   The numbers before each partition are an array of 8 bytes a partition, which the tasks get.
3. A keyed Feistel network permutes 0..N-1; cycle-walking repeats it until the result lies below N again. The result is
   the sequence's slot, a bijection: no slot is empty and none is taken twice.
4. Equal ranges of `records` slots are shards. One shuffle brings neighbouring shards together, sorted by slot, and each
   is written as records of equal length: slot s is record s % records of shard s div records. Only the last shard is shorter.

A reader seeks to (slot % records) * stride in the slot's shard and reads on; after a stop it resumes at any slot
(`records_from`). `read_slots` reads shards in executors, one bounded shard at a time, from the first slot's shard on. Files
are written by Spark's committer to any store that Spark writes, and a lost task is run again with the same result.

A record: number of ids (unsigned 32 bits), doc_id and place in it of the first id (signed 64 bits, -1 for a null
doc_id), then `length` ids of 16 bits (32 for larger vocabularies), padded with 0, and a line feed. All
little-endian. Null and empty texts are documents of the end id alone, very long ones run over many sequences; repeated
rows are documents of their own; an empty table gives no shards; only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small_batches, written
from .shingles import mixed
from .tokens import chunks, encoder, vocabulary

HEAD = "<Iqq"
HEAD_SIZE = struct.calcsize(HEAD)
#: Records that a worker holds at full length at a time.
AT_ONCE = 256


@dataclass(frozen=True)
class Layout:
    """What a reader has to know."""

    length: int = 2048
    wide: bool = False
    #: Records of a shard, which bounds what a task holds of it.
    records: int = 4096

    @property
    def ids(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")

    @property
    def stride(self) -> int:
        return HEAD_SIZE + self.length * self.ids.itemsize + 1

    def place(self, slot: int) -> tuple[int, int]:
        """The slot's shard and the byte where its record begins."""
        return slot // self.records, slot % self.records * self.stride


def permuted(numbers: np.ndarray, domain: int, key: int, rounds: int = 4) -> np.ndarray:
    """The positions of numbers below `domain` under a keyed bijection of 0..domain-1."""
    half = np.uint64(max(1, ((domain - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            turned = mixed(right ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)))
            left, right = right, left ^ (turned & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(domain)]
    return out


@functools.cache
def _codec():
    """Functions that squeeze and widen; one context for a worker."""
    try:
        import zstandard
    except ImportError:
        return lambda raw: zlib.compress(raw, 1), lambda packed, size: zlib.decompress(packed)
    squeeze, widen = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return squeeze.compress, lambda packed, size: widen.decompress(packed, max_output_size=size)


def squeezed(head: bytes, ids: np.ndarray) -> bytes:
    """A record without its padding, compressed for the way to its shard."""
    return _codec()[0](head + ids.tobytes())


def widened(packed: bytes, size: int) -> bytes:
    """The record of `size` bytes (without the line feed) that was squeezed."""
    return _codec()[1](packed, size).ljust(size, b"\0")


def sequences(docs: DataFrame, layout: Layout, end_id: int = 2, vocab: str | None = None) -> DataFrame:
    """part int, place long, packed binary: the sequences of each input partition in order."""
    path = vocab or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 4 * layout.length
        held: list[bytes] = []  # ids of the sequence that is being filled
        room, first = size, (-1, 0)

        def packed() -> bytes:
            ids = np.frombuffer(b"".join(held), "<u4")
            return squeezed(struct.pack(HEAD, len(ids), *first), ids.astype(layout.ids))

        def frame(records: list[bytes], start: int) -> pd.DataFrame:
            return pd.DataFrame({"part": np.int32(part), "place": np.arange(start, start + len(records), dtype=np.int64), "packed": records})

        for batch in batches:
            names, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for lo, hi in chunks(texts, 4_000_000):
                records = []
                for doc, ids in zip(names[lo:hi], encoder(path).encode(texts[lo:hi]), strict=True):
                    ids, at = ids + end, 0
                    doc = -1 if doc is None else int(doc)
                    while at < len(ids):
                        if room == size:
                            first = (doc, at // 4)
                        piece = ids[at : at + room]
                        held.append(piece)
                        at, room = at + len(piece), room - len(piece)
                        if not room:
                            records.append(packed())
                            held, room = [], size
                if records:
                    yield frame(records, made)
                    made += len(records)
        if held:
            yield frame([packed()], made)

    return docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(run, "part int, place long, packed binary")


def write_shards(docs: DataFrame, path: str, layout: Layout = Layout(), key: int = 1, together: int = 1, vocab: str | None = None) -> int:
    """Writes the shards, shard=<number>/part-*, below path; a task writes `together` neighbouring shards. Returns the number of sequences."""
    with small_batches(docs.sparkSession):
        return _write_shards(docs, path, layout, key, together, vocab)


def _write_shards(docs: DataFrame, path: str, layout: Layout, key: int, together: int, vocab: str | None) -> int:
    made = written(sequences(docs, layout, vocab=vocab), "sequences")
    counts = {r["part"]: r["n"] for r in made.groupBy("part").agg((F.max("place") + 1).alias("n")).collect()}
    sizes = np.zeros(max(counts, default=-1) + 1, np.int64)
    sizes[list(counts)] = list(counts.values())
    total = int(sizes.sum())
    before = docs.sparkSession.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    shards = max(1, -(-total // layout.records))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = permuted(before.value[batch["part"].to_numpy()] + batch["place"].to_numpy(), total, key).astype(np.int64)
            yield pd.DataFrame({"shard": (slots // layout.records).astype(np.int32), "slot": slots, "packed": batch["packed"]})

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):
                own = batch.iloc[lo : lo + AT_ONCE]
                yield pd.DataFrame({"value": [widened(x, layout.stride - 1) for x in own["packed"]], "shard": own["shard"].to_numpy()})

    dealt = made.mapInPandas(numbered, "shard int, slot long, packed binary").withColumn("task", F.expr(f"shard div {together}").cast("int"))
    ordered = dealt.repartitionById(-(-shards // together), F.col("task")).sortWithinPartitions("shard", "slot").select("shard", "packed")
    records = ordered.mapInPandas(unpacked, "value binary, shard int").select(F.col("value").cast("string").alias("value"), "shard")
    records.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)
    dropped(made)
    return total


def decoded(record: bytes, layout: Layout) -> tuple[int, int, np.ndarray]:
    """doc_id and place of the first id, and the ids."""
    count, doc, start = struct.unpack_from(HEAD, record)
    return doc, start, np.frombuffer(record, layout.ids, count, HEAD_SIZE)


def read_slots(spark: SparkSession, path: str, layout: Layout = Layout(), first_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, doc_id, start, n_tokens, input_ids (32 bits each) from first_slot on; earlier shards aren't read."""
    schema = "slot long, shard int, byte_offset long, doc_id long, start long, n_tokens long, input_ids binary"
    if not _listed(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where(F.col("shard") >= layout.place(first_slot)[0]).where("length > 0").select(F.col("shard").cast("int"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"], strict=True):
                view, count, slot = memoryview(content), len(content) // layout.stride, int(shard) * layout.records
                for lo in range(max(0, first_slot - slot), count, AT_ONCE):
                    rows = []
                    for i in range(lo, min(lo + AT_ONCE, count)):
                        doc, start, ids = decoded(view[i * layout.stride : (i + 1) * layout.stride], layout)
                        rows.append((slot + i, shard, i * layout.stride, doc, start, len(ids), ids.astype("<u4").tobytes()))
                    yield pd.DataFrame(rows, columns=["slot", "shard", "byte_offset", "doc_id", "start", "n_tokens", "input_ids"])

    return files.mapInPandas(run, schema)


def _listed(spark: SparkSession, path: str, shard: int | None = None) -> list:
    """The shards' folders, or one shard's files, that hold anything."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if shard is None else f"{path}/shard={shard}")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    return [x.getPath() for x in store.listStatus(at) if x.getPath().getName().startswith("shard=" if shard is None else "part-") and (shard is None or x.getLen())]


def records_from(spark: SparkSession, path: str, layout: Layout = Layout(), slot: int = 0, at_once: int = 256) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """slot, doc_id, start and ids in order from any slot on: seeks to its record and reads `at_once` records at a time."""
    while found := _listed(spark, path, layout.place(slot)[0]):
        shard, offset = layout.place(slot)
        stream = found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(found[0])
        try:
            stream.seek(offset)
            while chunk := bytes(stream.readNBytes(at_once * layout.stride)):
                for lo in range(0, len(chunk), layout.stride):
                    yield slot, *decoded(chunk[lo : lo + layout.stride], layout)
                    slot += 1
        finally:
            stream.close()
        if layout.place(slot)[0] == shard:
            return  # the last shard
