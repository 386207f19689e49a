"""Benchmark decontamination by winnowing, in DataFrame functions alone.

1. Both sides hash every run of `gram` words and keep the least hash of each window of `length - gram + 1` runs
   (the leftmost of equal ones). A span of `length` words holds exactly such a window, so every shared span of
   that length shares a kept hash.
2. Kept hashes of the documents are joined with the distinct kept hashes of the benchmark. Hits are gathered by text (a
   128-bit hash of it stands for the text, so copies are one).
3. Hits are extended: each window of `length` words around a hit is joined, word by word, with the windows of the items, so a
   collision never counts. What is met covers the document's words and names the items.

Items shorter than a window are whole windows; they are found by their first word and extended in the same way.
Joins broadcast the smaller side only where its counted rows are at most BROADCAST; otherwise both sides are shuffled. A place of
a document meets distinct windows, not places of items, so texts that repeat one word cost no more than others.

Null texts and texts without words have no words and no hits; items without words have no windows; repeated
items count once by item_id; items without an item_id count like others, but no name stands for them in item_ids;
an empty benchmark leaves every document clean; an empty table gives no rows; repeated documents have the same result each;
texts of any length are taken whole (places have 31 bits, as many as an array can have); columns other than doc_id and text are
ignored, whatever their names, and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words, written

#: A kept hash and its place in one number: the place in the lower bits.
PLACE_BITS = 31
PLACES = (1 << PLACE_BITS) - 1
#: Rows up to which a side of a join is broadcast: at most about 30 MB.
BROADCAST = 200_000


def _hash(parts: list[Column]) -> Column:
    """32 bits of a hash of some words."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 32) - 1))


def _grams(w: Column, gram: int) -> Column:
    """For each run of `gram` words its hash and place in one number."""

    def at(i: Column) -> Column:
        return F.shiftleft(_hash([F.get(w, i + j if j else i) for j in range(gram)]), PLACE_BITS).bitwiseOR(i.cast("long"))

    return F.when(F.size(w) >= gram, F.transform(F.sequence(F.lit(0), F.size(w) - gram), at)).otherwise(F.array().cast("array<long>"))


def _kept(grams: Column, window: int) -> Column:
    """The distinct least numbers of all windows: by hash, then leftmost."""
    def least(g: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(g) - (window - 1)), lambda i: F.array_min(F.slice(g, i, window)))
        return F.when(F.size(g) >= window, F.array_distinct(every)).otherwise(F.array().cast("array<long>"))

    return let(grams, least)


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit(7), whole).alias("_k2")]


def _joined(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST else right, on, how)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, w: the words of the items that have any."""
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)


def _windows(items: DataFrame, length: int) -> DataFrame:
    """phrase, item_id: the distinct windows of the items."""
    size = F.least(F.size("w"), F.lit(length))
    phrases = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return items.select("item_id", F.explode(F.array_distinct(phrases)).alias("phrase")).distinct()


def _prepared(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, _k1, _k2, n (words), kept (numbers of the kept hashes): all that the texts are read for, written once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(F.col("text")), let(words(F.col("text").cast("string")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _kept(_grams(w, gram), length - gram + 1).alias("kept"))).alias("w"))
    return written(texts.select("doc_id", "_k1", "_k2", "w.n", "w.kept"), "fingerprints")


def _hits(prepared: DataFrame, docs: DataFrame, items: DataFrame, length: int, gram: int) -> DataFrame:
    """_k1, _k2, places: where a text has a kept hash of the benchmark (size 0) or the first word of a short item (its size)."""
    kept_of = lambda w: _kept(_grams(w, gram), length - gram + 1)
    index = written(items.where(F.size("w") >= length).select(F.explode(kept_of(F.col("w"))).alias("v")).select(F.shiftright("v", PLACE_BITS).alias("h")).distinct(), "index")
    kept = prepared.select("_k1", "_k2", F.explode("kept").alias("v"))
    kept = kept.select("_k1", "_k2", F.shiftright("v", PLACE_BITS).alias("h"), F.col("v").bitwiseAND(F.lit(PLACES)).cast("int").alias("at"))
    found = _joined(kept, index, ["h"], index.count()).select("_k1", "_k2", F.struct("at", F.lit(0).alias("size")).alias("place"))
    firsts = written(items.where(F.size("w") < length).select(F.get("w", F.lit(0)).alias("word"), F.size("w").alias("size")).distinct(), "firsts")
    if short := firsts.count():
        every = docs.select(*_key(F.col("text")), F.posexplode(words(F.col("text").cast("string"))).alias("at", "word"))
        found = found.union(_joined(every, firsts, ["word"], short).select("_k1", "_k2", F.struct("at", "size").alias("place")))
    return found.groupBy("_k1", "_k2").agg(F.collect_set("place").alias("places"))


def _found(prepared: DataFrame, docs: DataFrame, benchmark: DataFrame, length: int, gram: int) -> tuple[DataFrame, int]:
    """_k1, _k2, windows (start, length; by start), item_ids (sorted) of the texts that hold a window, and the number of rows."""
    items = _items(benchmark)
    hits = written(_hits(prepared, docs, items, length, gram), "hits")
    around = lambda p: F.when(p["size"] > 0, F.array(F.struct(p["at"].alias("start"), p["size"].alias("length")))).otherwise(
        F.transform(F.sequence(F.greatest(p["at"] - (length - gram), F.lit(0)), p["at"]), lambda s: F.struct(s.alias("start"), F.lit(length).alias("length")))
    )
    weight = hits.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0]
    met = _joined(docs.select(*_key(F.col("text")), F.col("text").cast("string").alias("_text")), hits, ["_k1", "_k2"], weight)
    tried = lambda w: F.transform(
        F.filter(F.array_distinct(F.flatten(F.transform("places", around))), lambda x: x["start"] + x["length"] <= F.size(w)),
        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), F.array_join(F.slice(w, x["start"] + 1, x["length"]), " ").alias("phrase")),
    )
    tried_rows = met.select("_k1", "_k2", F.explode(let(words(F.col("_text")), tried)).alias("x")).select("_k1", "_k2", "x.start", "x.length", "x.phrase")
    windows = written(_windows(items, length), "windows")
    same = _joined(tried_rows, windows, ["phrase"], windows.count())
    found = same.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("windows"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = written(found, "found")
    return found, found.agg(F.coalesce(F.sum(F.size("windows") + F.size("item_ids") + 4), F.lit(0))).first()[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, gram: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside windows that occur), item_ids (sorted) and the windows."""
    prepared = _prepared(docs, length, gram)
    found, weight = _found(prepared, docs, benchmark, length, gram)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"])).cast("long")).alias("n"))

    found = found.withColumn("n_hit", F.aggregate("windows", start, grow, lambda acc: acc["n"]))
    rows = prepared.select("doc_id", F.col("n").alias("n_words"), "_k1", "_k2")
    none = F.array().cast("array<string>")
    return _joined(rows, found, ["_k1", "_k2"], weight, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("windows", F.array().cast("array<struct<start:int,length:int>>")).alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame, length: int = 10, gram: int = 5) -> DataFrame:
    """The documents without any benchmark window, with the columns they had."""
    found, weight = _found(_prepared(docs, length, gram), docs, benchmark, length, gram)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *_key(F.col("text")))
    return _joined(rows, found.select("_k1", "_k2"), ["_k1", "_k2"], weight, "left_anti").select("_row.*")
