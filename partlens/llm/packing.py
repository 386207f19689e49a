"""Packing: Karmarkar-Karp multiway differencing of document pieces into near-equal windows.

A document longer than a window gives whole windows of its own; what is left, cut into pieces of at most
`piece` tokens, joins others. Pieces are gathered in the order of the input until they fill `group` windows
but for a share `slack`, and are then differenced: partial partitions are merged largest difference first, the largest sums of the one
with the smallest of the other. If a window exceeds the capacity, the group gets one window more. Groups
are formed within input partitions, so nothing is shuffled and a lost task is simply run again.

Results: null or empty texts are documents of the end token alone; repeated rows are packed each on its own;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import chunks, encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, input_ids binary"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of `sizes` in `windows` groups of near-equal sums.

    A partial partition keeps only its filled slots, by falling sum; the others are 0.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:  # the smallest slots of a meet the smallest of b crosswise, the rest meets empty slots
            met = [(s + t, x + y) for (s, x), (t, y) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
            merged = a[: len(a) - over] + met + b[: len(b) - over]
        merged.sort(key=lambda slot: -slot[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    return [members for _, members in heap[0][2]] if heap else []


def assign(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their count rises until all fit (at worst one piece each)."""
    windows = -(-sum(sizes) // capacity)
    while True:
        groups = difference(sizes, windows)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        windows += 1


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, piece: int = 1024, group: int = 96, slack: float = 0.003, vocab: str | None = None) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence, and its ids (little-endian, 32 bits)."""
    path = vocab or vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    full = int(group * capacity * (1 - slack))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []  # doc_id, start, ids, tokens of the document
        filled = 0

        def settle() -> list[tuple]:
            nonlocal made, waiting, filled
            rows = []
            for members in assign([len(x[2]) // 4 for x in waiting], capacity):
                offset = 0
                for i in sorted(members):
                    doc, start, ids, tokens = waiting[i]
                    rows.append((doc, start, len(ids) // 4, tokens, base + made, offset, ids))
                    offset += len(ids) // 4
                made += 1
            waiting, filled = [], 0
            return rows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame([r[1:] for r in rows], columns=["start", "length", "doc_tokens", "sequence_id", "offset", "input_ids"])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
            return out

        for batch in batches:
            ids_of, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for lo, hi in chunks(texts, 4_000_000):
                rows = []
                for doc, ids in zip(ids_of[lo:hi], encoder(path).encode(texts[lo:hi]), strict=True):
                    ids += end
                    doc = None if doc is None else int(doc)
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        rows.append((doc, start, capacity, total, base + made, 0, ids[4 * start : 4 * (start + capacity)]))
                        made += 1
                    for start in range(whole, total, piece):
                        part = ids[4 * start : 4 * min(start + piece, total)]
                        if filled + len(part) // 4 > full:
                            rows += settle()
                        waiting.append((doc, start, part, total))
                        filled += len(part) // 4
                if rows:
                    yield frame(rows)
        if waiting:
            yield frame(settle())

    schema = T.StructType.fromDDL(SCHEMA)
    return docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(run, schema)
