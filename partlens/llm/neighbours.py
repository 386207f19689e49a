"""Approximate nearest neighbours by cosine through multi-index hashing of learned rotated binary codes.

1. On a bounded sample (`sample` rows by a hash of vec_id) several rotations are learned (iterative quantisation from
   different starts); the signs of the rotated vectors are the code, `rotations` bits per dimension. The radius is the
   Hamming distance that holds a share `aim` of the sample's true neighbours.
2. The table is dealt into buckets of bounded size by a hash of vec_id, the queries into blocks. Each bucket builds an
   index for each substring of its codes: rows in the order of the substring's value, and where each value begins.
3. A query probes in each substring the values within its reach. By the pigeonhole a code within radius r = q*m + a of
   m substrings differs by at most q bits in one of the first a + 1, or by at most q - 1 in one of the others, so
   probing these retrieves every code within the radius. Substrings have 8 or 16 bits, by what the probes of a bucket cost.
4. What is retrieved is filtered by the exact Hamming distance, and only vectors within the radius are compared by
   their floats and scored exactly. A query that finds fewer than k within the radius in a bucket takes the
   bucket's nearest codes beyond it.

Each task returns its best per query and the best of those are kept, so a task holds bounded parts of both sides
whatever repeats in the data.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths aren't
compared; lengths other than the commonest are searched without codes. Ties go to the smaller vec_id; a repeated vec_id
is a candidate once for each of its rows, but never for itself. With under k other vectors all of them are returned.
An empty table gives no rows. Only vec_id, embedding and what `queries` names are read, so other columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the table, and queries, that a task holds; queries that are marked at a time.
BUCKET, BLOCK, MARKED = 16_384, 4_096, 128


@dataclass
class Code:
    """Learned rotations and the radius to search."""

    rotation: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, whole 64-bit words."""
        return np.packbits(unit @ self.rotation > 0, axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of codes (rows of bytes, whole words), broadcast over all but the last axis."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1, dtype=np.uint16)


def masks(bits: int, reach: int) -> np.ndarray:
    """All numbers of so many bits with at most `reach` bits set; none if reach is negative."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= reach] if reach >= 0 else every[:0]


def reaches(radius: int, parts: int) -> list[int]:
    """How many bits each substring may differ by, so that every code within the radius is met in one of them."""
    whole, rest = divmod(radius, parts)
    return [whole if j <= rest else whole - 1 for j in range(parts)]


class Index:
    """For each substring the rows in the order of its value, and where each value begins."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        cost = {}
        for bits in (8, 16):  # entries fetched by a query, and values probed
            balls = [sum(math.comb(bits, i) for i in range(r + 1)) for r in reaches(radius, codes.shape[1] * 8 // bits)]
            cost[bits] = sum(balls) * (len(codes) / (1 << bits) + 1)
        self.bits = min(cost, key=lambda b: cost[b])
        parts = self.parts(codes)
        self.reach = reaches(radius, parts.shape[1])
        self.order = [np.argsort(parts[:, j], kind="stable").astype(np.int32) for j in range(parts.shape[1])]
        self.first = [np.searchsorted(parts[o, j], np.arange((1 << self.bits) + 1)) for j, o in enumerate(self.order)]
        self.masks = {r: masks(self.bits, min(r, self.bits)) for r in set(self.reach)}

    def parts(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint8 if self.bits == 8 else np.uint16)

    def fetched(self, part: int, value: int) -> np.ndarray:
        """The rows whose substring lies within reach of the value."""
        probes = self.masks[self.reach[part]] ^ np.uint32(value)
        begin, first = self.first[part][probes], self.first[part]
        sizes = first[probes + 1] - begin
        skipped = np.cumsum(sizes) - sizes
        return self.order[part][np.repeat(begin - skipped, sizes) + np.arange(sizes.sum())]

    def marked(self, queries: np.ndarray) -> np.ndarray:
        """Which rows are retrieved for which queries."""
        out = np.zeros((len(queries), len(self.codes)), bool)
        values = self.parts(queries)
        for part in range(values.shape[1]):
            for value in np.unique(values[:, part]):
                out[np.ix_(np.flatnonzero(values[:, part] == value), self.fetched(part, int(value)))] = True
        return out

    def within(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each query the rows within the radius."""
        found = []
        for lo in range(0, len(queries), MARKED):
            for own, met in zip(queries[lo : lo + MARKED], self.marked(queries[lo : lo + MARKED]), strict=True):
                rows = np.flatnonzero(met)
                found.append(rows[hamming(self.codes[rows], own) <= self.radius])
        return found


def learn(sample: np.ndarray, rotations: int = 4, rounds: int = 30, k: int = 5, aim: float = 0.98) -> Code:
    """Rotations by iterative quantisation (the best orthogonal map onto the current signs, again and again)."""
    width = sample.shape[1]
    unit = unit_rows(sample)
    draw, found = np.random.default_rng(3), []
    for _ in range(max(rotations, -(-64 // width))):
        turn = np.linalg.qr(draw.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(unit.T @ np.where(unit @ turn > 0, 1.0, -1.0))
            turn = u @ vt
        found.append(turn)
    rotation = np.concatenate(found, axis=1)
    code = Code(rotation[:, : rotation.shape[1] // 64 * 64], 0)
    probes = unit[:: max(1, len(unit) // 256)][:256]
    near = probes @ unit.T
    best = np.argsort(-near, axis=1, kind="stable")[:, 1 : k + 1]
    far = hamming(code.of(probes)[:, None], code.of(unit)[None])
    apart = np.take_along_axis(far, best, axis=1).ravel()
    # neighbours in the whole table are nearer than those in the sample, so the sample's radius is a safe one
    code.radius = int(np.quantile(apart, aim, method="higher")) if len(apart) else code.rotation.shape[1]
    return code


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, code: Code | None, k: int) -> list[tuple[int, int, float]]:
    """query_id, vec_id, cosine of each query's k nearest found among the rows; without a code all rows are compared."""
    unit, units = unit_rows(queries), unit_rows(rows)
    lengths, out = np.sqrt((rows * rows).sum(axis=1)), []
    if code:
        own, theirs = code.of(unit), code.of(units)
        met = Index(theirs, code.radius).within(own)
    for i, name in enumerate(query_ids):
        pick = met[i] if code else np.arange(len(ids))
        pick = pick[ids[pick] != name]
        if code and len(pick) < k:  # beyond the radius: by code distance, whole ties
            others = np.flatnonzero(ids != name)
            far = hamming(theirs[others], own[i])
            pick = others[far <= np.partition(far, k - 1)[k - 1]] if len(others) > k else others
        if len(pick) > k:
            about = units[pick] @ unit[i]
            pick = pick[about >= np.partition(about, len(pick) - k)[len(pick) - k] - 1e-9]
        q = queries[i]
        score = (rows[pick] * q).sum(axis=1) / (lengths[pick] * np.sqrt((q * q).sum()))
        for j in np.lexsort((ids[pick], -score))[:k]:
            out.append((int(name), int(ids[pick][j]), float(score[j])))
    return out


def usable(embedding: Column) -> Column:
    """The vector, null if it takes no part."""
    v = embedding.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & F.exists(v, lambda x: x != 0), embedding)


def search(table: DataFrame, queries: Column, k: int = 5, sample: int = 4_000, rotations: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of table(vec_id, embedding) where `queries` holds."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("v"), queries.alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v"))
    shape = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).agg(F.max(F.struct("n", -F.col("width"))).alias("m"), F.sum("n").alias("n"), F.sum("asked").alias("asked")).first()
    schema = "query_id long, vec_id long, score double"
    if shape["m"] is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count, width = shape["m"][0], -shape["m"][1]
    share = max(1, -(-count // sample))
    fitted = np.array([r[0] for r in rows.where(F.expr(f"width = {width} AND pmod(xxhash64(vec_id), {share}) = 0")).select("v").limit(2 * sample).collect()], np.float64)
    code = learn(fitted, rotations, k=k) if len(fitted) > k else None
    buckets, blocks = max(1, -(-shape["n"] // BUCKET)), max(1, -(-shape["asked"] // BLOCK))
    shared = table.sparkSession.sparkContext.broadcast(code)
    dealt = rows.select("vec_id", "v", "width", F.expr(f"pmod(xxhash64(vec_id), {buckets})").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "width", F.expr(f"pmod(xxhash64(vec_id, 5), {blocks})").cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket")).distinct()

    def run(part: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(questions):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        known = shared.value if part["width"].iloc[0] == width else None
        stacked = lambda x: np.stack(x.to_list()).astype(np.float64)
        found = nearest(stacked(questions["q"]), questions["query_id"].to_numpy(), stacked(part["v"]), part["vec_id"].to_numpy(), known, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = dealt.groupBy("width", "bucket", "block").cogroup(asking.groupBy("width", "bucket", "block")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
