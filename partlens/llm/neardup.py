"""N-gram Jaccard join by MinHash banding: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Each text gives its shingle set's key and `bands` band hashes of `rows` minima. At the threshold a pair
   shares no band with probability (1 - 0.8 ** rows) ** bands: 6e-5 for 32 bands of 6, i.e. recall 0.99994.
2. Texts of the same set are one class of copies; only its least doc_id goes on. A third of all rows being
   copies costs one pre-aggregated group-by.
3. Band hashes are shuffled; each member of a shared bucket is tied to the bucket's least member, so a bucket
   of n members gives n - 1 ties, not n * n pairs. Tied documents make candidate groups.
4. Within candidate groups all pairs are verified on full sets. A large group is dealt into blocks of bounded
   size and each pair of blocks is a task of its own; matrix products count the intersections. A task returns
   one row per member: its number of links and its least linked member, never pairs.
5. Links make classes; copies rejoin their representative.

Result: a row for each row of the input with doc_id, class_id (least doc_id of the class) and n_links (other
rows whose similarity is at least the threshold, copies included). Texts that are null or hold no word, and
rows whose doc_id is null, link with nothing. Rows of one doc_id with different texts are documents of their own: what
is linked are shingle sets, numbered by a 64-bit hash of their 128-bit key (at 50 million sets a chance of 7e-5 that
any two share a number).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components
from .shingles import mixed, shingle_set

#: Members and bytes of text in a block of a candidate group.
BLOCK_ROWS, BLOCK_BYTES = 512, 8_000_000
#: Bytes of text that a task verifies at a time.
TASK_BYTES = 6_000_000


def family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of the hash functions, the same everywhere."""
    draw = np.random.default_rng(20240607)
    return draw.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, count, np.uint32)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The set's band hashes as signed 64-bit numbers; the band's number is part of each."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        np.minimum(least, (folded[at : at + 1024, None] * times + plus).min(axis=0), out=least)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, the set's key (null without words), bytes of text, band hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, plus = family(bands * rows)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                own = shingle_set(text, size)
                doc = None if doc is None else int(doc)
                if doc is None or not len(own):
                    out.append((doc, None, 0, None))
                else:
                    out.append((doc, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(text), band_hashes(own, bands, rows, times, plus)))
            frame = pd.DataFrame([x[1:] for x in out], columns=["key", "size", "bands"])
            frame.insert(0, "doc_id", pd.array([x[0] for x in out], dtype="Int64"))
            frame.insert(1, "mark", batch["mark"].to_numpy())
            yield frame

    return docs.select(F.col("doc_id").cast("long").cast("string"), _mark(F.col("text")).alias("mark"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, mark long, key binary, size long, bands array<long>")


def _dense(index: np.ndarray, owner: np.ndarray, rows: int, lo: int, width: int) -> np.ndarray:
    block = np.zeros((rows, width), np.float32)
    block[owner, index - lo] = 1
    return block


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by blocks of columns of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    index, owner = (np.cumsum(shared) - 1)[index[shared[index]]], owner[shared[index]]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    total, width = np.zeros((len(left), len(right)), np.float64), 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(index, [lo, lo + width])
        block = _dense(index[a:b], owner[a:b], len(sets), lo, width)
        total += block[left] @ block[right].T
    return total


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of sets[left] are similar to which of sets[right]."""
    sizes = np.array([len(s) for s in sets], np.float64)
    total = intersections(sets, left, right)
    return total * (1 + threshold) >= threshold * (sizes[left][:, None] + sizes[right][None, :]) - 1e-9


def _settle(part: pd.DataFrame, size: int, threshold: float) -> list[tuple[int, int, int]]:
    """For each member of a task: its least linked member and the copies it links with."""
    seen: dict[int, tuple] = {}
    for rep, key, side, copies, text in zip(part["node"], part["key"], part["side"], part["copies"], part["text"], strict=True):
        if rep not in seen:
            own = shingle_set(text, size)
            if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == key:
                seen[rep] = (own, side, copies)
    reps, sets = list(seen), [x[0] for x in seen.values()]
    if len(reps) < 2:
        return []
    side, copies = np.array([x[1] for x in seen.values()]), np.array([x[2] for x in seen.values()], np.int64)
    alone = part["i"].iloc[0] == part["j"].iloc[0]
    left, right = (np.arange(len(reps)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    near = linked(sets, left, right, threshold)
    if alone:
        np.fill_diagonal(near, False)
    degree, ids = np.zeros(len(reps), np.int64), np.array(reps, np.int64)
    degree[left] += near @ copies[right]
    if not alone:
        degree[right] += copies[left] @ near
    labels = ids.copy()
    far = np.iinfo(np.int64).max
    while True:  # the least label spreads over links
        grown = labels.copy()
        if near.any():
            grown[left] = np.minimum(grown[left], np.where(near, labels[right][None, :], far).min(axis=1))
            grown[right] = np.minimum(grown[right], np.where(near, labels[left][:, None], far).min(axis=0))
        if (grown == labels).all():
            break
        labels = grown
    return [(int(r), int(b), int(d)) for r, b, d in zip(ids, labels, degree, strict=True) if d]


def classified(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6) -> DataFrame:
    """doc_id, mark (hash of the text), class (null without words), class_id, n_links for each row of documents(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = written(signatures(texts, size, bands, rows), "signatures")
    reps = written(marks.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.min_by("bands", "doc_id").alias("bands")).withColumn("node", F.xxhash64("key")), "copies")
    entries = reps.select("node", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = entries.join(buckets, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(ties, "ties").join(reps.select("node", "rep", "key", "copies", "size"), "node")
    total = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    dealt = groups.join(total, "root").withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
    tasks = dealt.select("root", "node", "rep", "key", "copies", "size", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    tasks = tasks.select("root", "node", "rep", "key", "copies", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    tasks = written(tasks, "tasks")
    bins = max(1, -(-(tasks.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    work = tasks.withColumn("bin", F.expr(f"pmod(xxhash64(root, i, j), {bins})")).join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, own in part.groupby(["root", "i", "j"], sort=False):
            out += _settle(own, size, threshold)
        return pd.DataFrame(out, columns=["a", "b", "links"])

    links = written(work.groupBy("bin").applyInPandas(verify, "a long, b long, links long"), "links")
    found = components(links.select("a", "b"), "classes").join(reps.select("node", "rep"), "node")
    found = found.join(found.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "root", "class_id")
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    settled = reps.select("key", "node", "rep", "copies").join(found, "node", "left").join(degree, "node", "left")
    settled = settled.select("key", F.coalesce("root", "node").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return marks.select("doc_id", "mark", "key").join(settled, "key", "left").select("doc_id", "mark", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links for each row of documents(doc_id, text)."""
    return classified(docs, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each class left, its least doc_id; of rows that repeat doc_id and text one stays, rows without doc_id all stay."""
    rows = classified(docs, **options).where("doc_id IS NOT NULL")
    firsts = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("f")).select("f.doc_id", "f.mark")
    firsts = firsts.union(rows.where("class IS NULL").select("doc_id", "mark")).distinct().select(F.col("doc_id").alias("_first"), F.col("mark").alias("_of"))
    named = docs.where("doc_id IS NOT NULL").withColumn("_mark", _mark(F.col("text")))
    named = named.join(firsts, (F.col("doc_id") == F.col("_first")) & (F.col("_mark") == F.col("_of")), "left_semi").dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return named.unionByName(docs.where("doc_id IS NULL"))
