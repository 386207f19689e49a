"""Weighted words, word pairs and runs of signs of whole texts, as packed numbers: what a text counts stays in its row.

A text's tokens are never rows. Workers take some hundred texts apart at once, as arrays of signs. The vocabulary is exact: a first reading bounds each token's total from above, a second one counts every token whose bound
reaches the place that is asked for, and the place is lowered until nothing left out could stand there.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.session import written

#: Rows to a worker at a time, numbers in a table of texts and tokens, distinct tokens a worker holds, frequent ones it tells of (for each 5000 asked for), signs it takes apart at a time.
ROWS, CELLS, HELD, TOLD, LETTERS = 500, 1 << 21, 300_000, 20_000, 1 << 22
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Bits of a sign's number where 5 signs make one number.
SIGN = 12


def cut(text: Column) -> Column:
    """The text in small letters, which Texts takes apart."""
    return F.lower(F.coalesce(text, F.lit(""))).alias("lowered")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """What each sign is: 1 a word's (as Java's (?U)\\w), 2 a blank (as Java's \\s), else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(i))
        out[i] = k[0] in "LM" or k in ("Nd", "Nl", "Pc")
    for a, b in ((0x24B6, 0x24EA), (0x1F130, 0x1F14A), (0x1F150, 0x1F16A), (0x1F170, 0x1F18A), (0x200C, 0x200E)):
        out[a:b] = 1
    out[[9, 10, 11, 12, 13, 32]] = 2
    return out


class Texts:
    """The signs of some texts one after the other, a blank before and after each, taken apart all at once."""

    def __init__(self, column: pa.Array) -> None:
        texts = column.to_pylist()
        whole = "\n" + "\n".join(texts) + "\n"
        self.bytes = np.frombuffer(whole.encode(), np.uint8)
        self.signs = self.bytes if len(self.bytes) == len(whole) else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum([len(x) + 1 for x in texts])  # of each text's signs, by the blank after it
        self.kind = _kinds()[self.signs]

    def row(self, at: np.ndarray) -> np.ndarray:
        """Whose the signs at these ascending places are."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(at, self.ends + 1), prepend=0))

    def runs(self, mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Text and code of each run of at least so many signs of the mask, and what the codes stand for."""
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        begin, long = edge[::2], edge[1::2] - edge[::2]
        if least > 1:
            mask[begin[long < least]] = False
            begin, long = begin[long >= least], long[long >= least]
        end = np.cumsum(long)
        if self.signs is self.bytes:
            flat = self.bytes[mask]
        else:
            width = 1 + (self.signs > 0x7F).astype(np.int8) + (self.signs > 0x7FF) + (self.signs > 0xFFFF)
            flat, end = self.bytes[np.repeat(mask, width)], np.concatenate([[0], np.cumsum(width[mask])])[end]
        at = np.concatenate([[0], end]).astype(np.int64)
        told = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(flat)).dictionary_encode()
        return self.row(begin), told.indices.to_numpy().astype(np.int64), told.dictionary.to_pylist()

    def words(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        return self.runs(self.kind == 1, 2)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """What stands between blanks."""
        return self.runs(self.kind != 2, 1)


def portions(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """So many rows at a time, fewer where they are long."""
    size, at = np.cumsum(pc.binary_length(batch.column("lowered")).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        reach = np.searchsorted(size, (size[at - 1] if at else 0) + LETTERS, "right")
        end = min(batch.num_rows, at + rows, max(at + 1, int(reach)))
        yield batch.slice(at, end - at)
        at = end


class Runs:
    """Finds given runs of 3 to 5 signs in texts by a tree of their signs."""

    def __init__(self, place: dict[str, int]) -> None:
        signs = sorted({x for g in place for x in g} | {" "})
        self.size = len(signs) + 1
        self.to = np.zeros(sys.maxunicode + 1, np.int32)
        self.to[[ord(x) for x in signs]] = np.arange(1, self.size)
        edges, ends = {}, [-1, -1]  # 0: no such run; 1: the root
        for g, i in place.items():
            at = 1
            for x in g:
                key = at * self.size + int(self.to[ord(x)])
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                at = edges[key]
            ends[at] = i
        self.to[[9, 10, 11, 12, 13]] = self.to[32]
        self.ends = np.array(ends)
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.table = None
        if len(ends) * self.size <= 1 << 23:
            self.table = np.zeros(len(ends) * self.size, np.int32)
            self.table[self.keys] = self.next

    def step(self, at: np.ndarray, sign: np.ndarray) -> np.ndarray:
        key = at * np.int64(self.size) + sign
        if self.table is not None:
            return self.table[key]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.next[i], 0)

    def __call__(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and place of each run found."""
        if not len(self.keys):
            return
        sign = np.append(self.to[texts.signs], np.zeros(4, np.int32))
        where = np.arange(len(texts.signs))
        at = self.step(np.ones(len(where), np.int64), sign[where])
        for n in range(1, 5):
            alive = np.flatnonzero(at)
            where = where[alive]
            at = self.step(at[alive], sign[where + n])
            if n > 1:
                place = self.ends[at]
                fits = place >= 0
                yield texts.row(where[fits] + 1), place[fits]  # the second sign is never a blank


def runs(piece: str) -> list[str]:
    """Runs of 3 to 5 signs of a piece set in blanks."""
    w = f" {piece} " if piece else ""
    return [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]


def _numbered(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all pieces set in blanks, and whose they are."""
    signs = np.frombuffer("".join(f" {x} " if x else "" for x in pieces).encode("utf-32-le"), np.uint32)
    return signs, np.repeat(np.arange(len(pieces)), [len(x) + 2 if x else 0 for x in pieces])


def _coded(signs: np.ndarray, owner: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owner and number of each run whose signs are all known; known: ascending, without 0, shorter than 1 << SIGN."""
    to = np.zeros(sys.maxunicode + 1, np.int64)
    to[known] = np.arange(1, len(known) + 1)
    one = to[signs]
    code, fits = one, one > 0
    for n in (2, 3, 4, 5):
        m = max(0, len(one) - n + 1)
        code, fits = (code[:m] << SIGN) | one[n - 1 :], fits[:m] & (one[n - 1 :] > 0) & (owner[:m] == owner[n - 1 :])
        if n > 2:
            yield owner[:m][fits], code[fits]


def totals_of_runs(pieces: dict[str, int], most: int | None = None) -> dict[str, int]:
    """How often each run stands in the pieces, which stand so often; of many pieces' runs the `most` frequent ones only, and under "" how often at most any other stands there."""
    names, n = list(pieces), np.array(list(pieces.values()), np.int64)
    out: dict[str, int] = {}
    signs, owner = _numbered(names)
    known = np.unique(signs)
    if not len(known):
        return out
    if known[0] == 0 or len(known) >= 1 << SIGN:  # a sign is no sign's padding; too many signs for a number
        for x in names:
            for g in runs(x):
                out[g] = out.get(g, 0) + pieces[x]
        return out
    for who, code in _coded(signs, owner, known):
        code, total = _summed(code, n[who])
        if most and len(code) > most:
            least = int(np.partition(total, -most)[-most]) + 1
            code, total = code[total >= least], total[total >= least]
            out[""] = max(out.get("", 0), least - 1)
        each = np.stack([(code >> (SIGN * i)) & ((1 << SIGN) - 1) for i in (4, 3, 2, 1, 0)], 1)
        each = np.where(each > 0, known[each - 1], 0)
        blank = (each == 0).sum(1)
        left = np.take_along_axis(each, (np.arange(5) + blank[:, None]) % 5, 1).astype(np.uint32)
        for g, x in zip(np.ascontiguousarray(left).view("<U5").ravel().tolist(), total.tolist(), strict=True):
            out[g] = x
    return out


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a column of bytes, one row's after the other's, and how many each row has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its n."""
    told = pa.array(key).dictionary_encode()
    return told.dictionary.to_numpy(), np.bincount(told.indices.to_numpy(), n, len(told.dictionary)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def census(docs: DataFrame, whole: bool, told: int | None = None) -> DataFrame:
    """kind (w, p for pairs, c, or s), token, n: totals by worker. Unless whole, a worker tells of its frequent tokens only; s sums by kind how often at most any other stands there."""
    most = told or TOLD

    def tell(kind: str, counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(counts), pa.string()), "token": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces, pairs, held = {}, {}, [], 0
        total = {"w": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)}

        def least_of(n: np.ndarray) -> int:
            return 1 if whole or len(n) <= most else int(np.partition(n, -most)[-most]) + 1

        def coded(kind: str, of: dict[str, int], code: np.ndarray, names: list[str]) -> np.ndarray:
            """The worker's codes in the place of a portion's, whose tokens are counted."""
            to = np.array([of.setdefault(x, len(of)) for x in names], np.int64)
            if len(of) > len(total[kind]):
                total[kind] = np.concatenate([total[kind], np.zeros(2 * len(of) - len(total[kind]), np.int64)])
            total[kind][to] += np.bincount(code, minlength=len(names))
            return to[code]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held
            names, slack = list(words), {}
            if pairs:
                key, n = pairs.pop() if len(pairs) == 1 else _merged(pairs)
                slack["p"] = (least := least_of(n)) - 1
                key, n = key[n >= least], n[n >= least]
                for at in range(0, len(key), 50_000):
                    some = key[at : at + 50_000]
                    yield tell("p", {f"{names[a]} {names[b]}": x for a, b, x in zip((some >> 32).tolist(), (some & 0xFFFFFFFF).tolist(), n[at : at + 50_000].tolist(), strict=True)})
            n = total["w"][: len(words)]
            slack["w"] = (least := least_of(n)) - 1
            yield tell("w", {names[i]: int(n[i]) for i in np.flatnonzero(n >= least)})
            counted = totals_of_runs(dict(zip(pieces, total["c"].tolist(), strict=False)), None if whole else most)
            slack["c"] = counted.pop("", 0)
            yield tell("c", counted)
            yield tell("s", {k: x for k, x in slack.items() if x})
            pairs.clear()
            words.clear()
            pieces.clear()
            total.update(w=np.zeros(0, np.int64), c=np.zeros(0, np.int64))
            held = 0

        for whole_batch in batches:
            for batch in portions(whole_batch, ROWS):
                texts = Texts(batch.column("lowered"))
                _, code, names = texts.pieces()
                coded("c", pieces, code, names)
                row, code, names = texts.words()
                code = coded("w", words, code, names)
                if len(code) > 1:
                    key = ((code[:-1] << 32) | code[1:])[row[:-1] == row[1:]]
                    pairs.append(_summed(key, np.ones(len(key))))
                    held += len(pairs[-1][0])
                    if held > 3_000_000:
                        pairs[:] = [_merged(pairs)]
                        held = len(pairs[0][0])
                if len(pairs) == 1 and held > 1_500_000 or len(pieces) > HELD:
                    yield from out()
        yield from out()

    return docs.select(cut(F.col("text"))).mapInArrow(run, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, tokens: list[tuple[str, str]]) -> DataFrame:
    """docs without their text, with at (places in tokens, ascending, 4 bytes each) and n (how often the text has them, 4 bytes each)."""
    keep = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    width = len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {"w": {}, "c": {}}
        for i, (kind, token) in enumerate(shared.value):
            place[kind][token] = i
        two = [(*t.split(" "), i) for t, i in place["w"].items() if " " in t]
        side = {w: i for i, w in enumerate(dict.fromkeys(w for a, b, _ in two for w in (a, b)))}
        code2 = np.array([side[a] * len(side) + side[b] for a, b, _ in two], np.int64)
        order = np.argsort(code2)
        code2, place2 = code2[order], np.array([i for *_, i in two], np.int64)[order]
        grams = Runs(place["c"])

        def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            texts, cells = Texts(batch.column("lowered")), batch.num_rows * width
            table = np.zeros(cells, np.int64)
            for row, what in grams(texts):
                table += np.bincount(row * width + what, minlength=cells)
            row, code, names = texts.words()
            one = np.array([place["w"].get(x, -1) for x in names], np.int64)[code]
            table += np.bincount((row * width + one)[one >= 0], minlength=cells)
            if len(code2) and len(code) > 1:
                part = np.array([side.get(x, -1) for x in names], np.int64)[code]
                a, b = part[:-1], part[1:]
                fits = (a >= 0) & (b >= 0) & (row[:-1] == row[1:])
                key, owner = (a * len(side) + b)[fits], row[:-1][fits]
                i = np.minimum(np.searchsorted(code2, key), len(code2) - 1)
                fits = code2[i] == key
                table += np.bincount(owner[fits] * width + place2[i[fits]], minlength=cells)
            at = np.flatnonzero(table)
            return (at % width).astype(np.uint32), table[at].astype(np.uint32), np.bincount(at // width, minlength=batch.num_rows)

        for whole in batches:
            parts = [counted(x) for x in portions(whole, max(1, CELLS // max(1, width)))] if width else []
            at, n, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(whole.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in keep), packed(at, size), packed(n, size)], names=[*keep, "at", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, cut(F.col("text"))).mapInArrow(run, f"{schema}, at binary, n binary")


def gathered(rows: DataFrame, run, tasks: int | None = None) -> list[bytes]:
    """What run makes of each task's batches, to the driver; as many tasks as there are cores, so that what is sent doesn't grow with the rows."""
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"x": pa.array([run(batches)], pa.binary())})

    return [r.x for r in rows.coalesce(tasks).mapInArrow(one, "x binary").collect()]


def spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each place stands, and how often in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        out = np.zeros((2, width))
        for batch in batches:
            at, n = joined(batch.column("at"), "u4")[0], joined(batch.column("n"), "u4")[0]
            out += [np.bincount(at, minlength=width), np.bincount(at, n, width)]
        return out.tobytes()

    df, total = sum((np.frombuffer(x).reshape(2, width) for x in gathered(rows.select("at", "n"), run)), np.zeros((2, width)))
    return df.astype(np.int64), total.astype(np.int64)


def learned(docs: DataFrame, documents: int, most: int, stop: tuple[str, ...] = (), least: dict[str, int] = {"w": 2, "c": 3}) -> tuple[DataFrame, list[tuple[str, str]], list[tuple[int, str, str, float]]]:
    """counts() of docs, the tokens counted, and the vocabulary: index, kind, token, idf of each kind's `most` frequent tokens that lie in enough documents."""
    kind = F.when(F.col("kind") == "p", "w").otherwise(F.col("kind"))
    whole, asked = False, most + most // 4 + 100
    totals = written(census(docs, False, TOLD * max(1, asked // 5000)), "totals")
    while True:
        slack = {r.token: r.n for r in totals.where("kind = 's'").collect()}
        real = totals.where("kind <> 's'").where(~((kind == "w") & F.col("token").isin(list(stop))) if stop else F.lit(True))
        floor = {}
        for k, d in least.items():
            top = real.where(kind == k).orderBy(F.desc("n")).limit(asked).agg(F.count("*"), F.min("n")).first()
            floor[k] = max(d, top[1]) if top[0] >= asked else d
        if not whole and any(0 < x >= floor["c" if k == "c" else "w"] for k, x in slack.items()):  # a token no worker told of could stand there
            whole, totals = True, written(census(docs, True), "totals")
            continue
        unsaid = F.lit(0)
        for k, x in slack.items():
            unsaid = F.when(F.col("kind") == k, x).otherwise(unsaid)
        reach = F.when(kind == "w", floor["w"]).otherwise(floor["c"])
        bound = F.col("n") + unsaid
        tokens = sorted((r.kind, r.token) for r in real.where(bound >= reach).select(kind.alias("kind"), "token").collect())
        rows = written(counts(docs, tokens), "counts", "zstd")
        df, total = spread(rows, len(tokens))
        kept, short = [], False
        for k, d in least.items():
            own = sorted((i for i, t in enumerate(tokens) if t[0] == k and df[i] >= d), key=lambda i: (-total[i], tokens[i][1]))
            short |= floor[k] > d and sum(total[i] >= floor[k] for i in own) < most
            kept += own[:most]
        if not short:
            return rows, tokens, [(i, *tokens[j], math.log((1 + documents) / (1 + int(df[j]))) + 1) for i, j in enumerate(sorted(kept))]
        asked *= 2


class Space:
    """Features of counted rows: (1 + ln n) idf at the vocabulary's index, each kind of a document scaled to length 1."""

    def __init__(self, tokens: list[tuple[str, str]], vocab: list[tuple[int, str, str, float]]) -> None:
        of = {(k, t): i for i, k, t, _ in vocab}
        self.width = len(vocab)
        self.to = np.array([of.get(t, -1) for t in tokens], np.int64)
        self.idf, self.kind = np.array([x[3] for x in vocab]), np.array([x[1] == "w" for x in vocab], np.int64)

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, index and value of each feature, by row."""
        (at, size), n = joined(batch.column("at"), "u4"), joined(batch.column("n"), "u4")[0]
        row, index = np.repeat(np.arange(batch.num_rows), size), self.to[at]
        fits = index >= 0
        row, index, n = row[fits], index[fits], n[fits]
        v = (1 + np.log(np.arange(1, n.max(initial=0) + 1))[n - 1] if n.max(initial=0) < 100_000 else 1 + np.log(n)) * self.idf[index]
        own = row * 2 + self.kind[index]
        size = np.sqrt(np.bincount(own, v * v, 2 * batch.num_rows))
        return row, index, (v / size[own]).astype(np.float32)

    def features(self, rows: DataFrame) -> DataFrame:
        """rows with their features packed (index and value) in the place of their counts, so that a pass over them has nothing to work out."""
        shared, kind = rows.sparkSession.sparkContext.broadcast(self), self.numbers
        keep = [c for c in rows.columns if c not in ("at", "n")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, index, value = shared.value(batch)
                size = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), packed(index.astype(kind), size), packed(value, size)], names=[*keep, "index", "value"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.mapInArrow(run, f"{schema}, index binary, value binary")

    @property
    def numbers(self) -> str:
        return "u2" if self.width < 1 << 16 else "u4"


def unpacked(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of each packed feature, by row."""
    index, size = joined(batch.column("index"), kind)
    return np.repeat(np.arange(batch.num_rows), size), index.astype(np.int64), joined(batch.column("value"), "f4")[0]


def tables(batch: pa.RecordBatch, kind: str, width: int, room: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows at a time with their packed features and a constant in a dense table, which room keeps for the next batch."""
    index, size = joined(batch.column("index"), kind)
    value, ends = joined(batch.column("value"), "f4")[0], np.concatenate([[0], np.cumsum(size)])
    step = max(1, CELLS // (width + 1))
    if not room:
        room.append(np.zeros((step, width + 1)))
    for start in range(0, batch.num_rows, step):
        end = min(batch.num_rows, start + step)
        a, b, x = ends[start], ends[end], room[0][: end - start]
        x.fill(0)
        x[:, -1] = 1
        x.ravel()[np.repeat(np.arange(end - start) * (width + 1), size[start:end]) + index[a:b]] = value[a:b]
        yield slice(start, end), x


class small_batches:
    """Whole texts and their features go to workers a few at a time while this holds."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(BATCH)
        if not 0 < int(self.before) <= ROWS:
            self.spark.conf.set(BATCH, str(ROWS))

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(BATCH, self.before)
