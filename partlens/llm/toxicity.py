"""Toxicity by a chain of classifiers: each category's linear model also sees the probabilities of earlier ones.

Training takes a bounded sample of the labelled rows (`sample` documents, chosen by a hash of doc_id, so the
same ones in every run). Later models are trained with out-of-fold probabilities of the earlier categories,
so that they meet in training what they meet in scoring. Each category's final model is the mean of its folds' models,
and its threshold comes from their out-of-fold probabilities; where these don't show with certainty that what is
flagged is mostly right, nothing is flagged. Folds go by a hash of the text: copies of a text never lie on both sides.

Features of a text: each distinct lower-cased word with its starts of 3 to 6 letters, hashed and scaled by
the square root of the number of distinct words, and a few shares (capitals, symbols, repeated words, the
most frequent word, length) in steps. Scoring runs over whole texts of all rows; a word's part in the sum
is cached. The models are two arrays of fixed size, whatever the corpus.

Results: null and empty texts score like a text without words, very long ones by all their words; without usable
labels (no rows, or one value only) a category's probability is near its share among the labels and nothing is
flagged; repeated rows score alike; an empty table gives no rows; columns of docs named like a result keep their values.
"""

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the number of hashed features; the last 64 are for the shares.
BITS = 18
WIDTH = 1 << BITS
SHARES = 64
WORDS = re.compile(r"[^\W\d_]+")
#: Words whose parts a worker keeps; a memory bound only.
CACHE = 300_000


def word_features(word: str) -> list[int]:
    """Hashed features of one word."""
    spelled = [f"={word}", *(f"<{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (WIDTH - SHARES) for x in spelled]


def step(share: float) -> int:
    return min(9, int(share * 10))


def text_shares(text: str, found: list[str], distinct: int) -> list[int]:
    """The stepped shares of a text, one feature each."""
    n = len(text)
    capitals = sum(map(str.isupper, found)) / len(found) if found else 0.0
    symbols = 1 - sum(map(len, found)) / n if n else 0.0
    repeats = 1 - distinct / len(found) if found else 0.0
    base = WIDTH - SHARES
    return [base + step(capitals), base + 10 + step(symbols), base + 20 + step(repeats), base + 30 + min(9, int(math.log2(n + 1) / 2))]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values."""
    text = text or ""
    found = WORDS.findall(text)
    distinct = {x.lower() for x in found}
    hashed = [f for w in sorted(distinct) for f in word_features(w)]
    shares = text_shares(text, found, len(distinct))
    scale = 1 / math.sqrt(max(1, len(distinct)))
    index, times = np.unique(np.array(hashed, np.int64), return_counts=True)
    return np.concatenate([index, np.array(shares, np.int64)]), np.concatenate([times * scale, np.full(len(shares), 0.3)])


@dataclass
class Rows:
    """Sparse rows, once by row and once by feature, so that both sums of a fitting step run along memory.

    Features are numbered densely; `used` has their numbers among all. Arrays are of 32 bits and made once; folds are
    told apart by weights of rows and copy nothing.
    """

    used: np.ndarray
    index: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    by_feature: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, index: np.ndarray, value: np.ndarray, lengths: np.ndarray, order: np.ndarray, least: int, most: float) -> "Rows":
        """The rows in the given order with the features that lie in `least` rows or more and at most a share `most` of them; the shares of a text always count."""
        often = np.zeros(WIDTH, np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        for lo in range(0, len(index), 1 << 20):  # counting makes wide copies
            often += np.bincount(index[lo : lo + (1 << 20)], minlength=WIDTH)
        fit = (often >= max(1, least)) & (often <= most * len(lengths))
        fit[WIDTH - SHARES :] = often[WIDTH - SHARES :] > 0
        dense = np.cumsum(fit, dtype=np.int32) - 1
        kept = [fit[index[at[r] : at[r + 1]]] for r in order]
        begin = np.concatenate([[0], np.cumsum([k.sum() for k in kept])]).astype(np.int64)
        columns, values = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.float32)
        for i, (r, k) in enumerate(zip(order, kept, strict=True)):
            columns[begin[i] : begin[i + 1]] = dense[index[at[r] : at[r + 1]][k]]
            values[begin[i] : begin[i + 1]] = value[at[r] : at[r + 1]][k]
        turn = np.argsort(columns, kind="stable").astype(np.int32)
        owner = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(begin))[turn]
        first = np.concatenate([[0], np.cumsum(often[fit])]).astype(np.int64)
        return cls(np.flatnonzero(fit), columns, values, begin, owner, values[turn], first)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Sums of weights (of the dense numbers) by row."""
        return np.add.reduceat(self.value * weights[self.index], self.begin[:-1])

    def back(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the rows' numbers by feature."""
        return np.add.reduceat(self.by_feature * rows[self.owner], self.first[:-1])


@dataclass
class Linear:
    """A logistic model over the hashed features and the earlier categories' logits."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float
    #: From which probability on a text belongs to the category.
    threshold: float = 0.5

    def logit(self, dots: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return dots + earlier @ self.chain + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def as_input(p: np.ndarray) -> np.ndarray:
    """Probabilities as the later models see them: bounded logits."""
    q = np.clip(p, 0.01, 0.99)
    return np.log(q / (1 - q)) / 4


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100, rate: float = 0.25, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam over all rows of weight 1: weights of the dense features, of the earlier categories, bias."""
    n, width, chain = weight.sum(), len(rows.used), earlier.shape[1]
    positive = float((weight * y).sum())
    share = (positive + 0.5) / (n + 1)
    theta = np.zeros(width + chain + 1)
    theta[-1] = np.log(share / (1 - share))
    if 0 < positive < n:
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            z = rows.dot(theta[:width].astype(np.float32)) + earlier @ theta[width : width + chain] + theta[-1]
            off = weight * (sigmoid(z) - y) / n
            grad = np.concatenate([rows.back(off.astype(np.float32)) + decay * theta[:width], earlier.T @ off, [off.sum()]])
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    return theta[:width], theta[width : width + chain], float(theta[-1])


def best_threshold(p: np.ndarray, y: np.ndarray, sure: float = 0.5, z: float = 1.645) -> float:
    """The threshold with the best F1 on out-of-fold probabilities, halfway (in logits) to the next lower one.

    Only thresholds count at which the share of right ones among those flagged is `sure` or more with 95 % certainty
    (the lower bound of Wilson's interval). Where the evidence is too thin for any, nothing is flagged: infinity.
    """
    if not len(y) or y.min() == y.max():
        return math.inf
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    share = hits / n
    lower = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    last = np.append(np.diff(p[order]) != 0, True)  # only between different probabilities
    allowed = last & (lower >= sure)
    if not allowed.any():
        return math.inf
    at = int(np.argmax(np.where(allowed, f1, -1)))
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    below = p[order][at + 1] if at + 1 < len(y) else p[order][at] / 2
    return float(sigmoid(np.array((logit(p[order][at]) + logit(below)) / 2)))


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray, folds: int = 4) -> list[Linear]:
    """One model for each column of labels, in order; the earlier probabilities it is trained with are out of fold.

    A category's model is the mean of its folds' models (the mean of linear models is linear), so what the threshold is
    chosen by, their out-of-fold probabilities, is on the scale of what it is used for.
    """
    earlier, models = np.zeros((len(labels), 0)), []
    for c in range(labels.shape[1]):
        y, p = labels[:, c], np.zeros(len(labels))
        made = []
        for f in range(folds):
            outside = fold == f
            if not outside.all():
                made.append(fit(rows, earlier, y, (~outside).astype(np.float64)))
                if outside.any():
                    w, chain, bias = made[-1]
                    p[outside] = sigmoid((rows.dot(w.astype(np.float32)) + earlier @ chain + bias)[outside])
        weights = np.zeros(WIDTH, np.float32)
        weights[rows.used] = np.mean([w for w, _, _ in made], axis=0)
        models.append(Linear(weights, np.mean([x for _, x, _ in made], axis=0), float(np.mean([b for _, _, b in made])), best_threshold(p, y)))
        earlier = np.column_stack([earlier, as_input(p)])
    return models


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int) -> DataFrame:
    """Features and labels of about `sample` labelled documents: those with the smallest hashes of doc_id."""
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.expr(e)).cast("double").alias(c) for c, e in categories.items())).dropna()
    count = named.count()
    share = min(1.0, sample / max(1, count))
    chosen = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(chosen(F.col("doc_id")))
    columns = list(categories)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            out = batch[columns].copy()
            out["fold"] = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]
            out["index"], out["value"] = [i.astype(np.int32) for i, _ in made], [v.astype(np.float32) for _, v in made]
            yield out

    schema = ", ".join(f"`{c}` double" for c in columns) + ", fold long, index array<int>, value array<float>"
    return some.join(named.where(chosen(F.col("doc_id"))), "doc_id").mapInPandas(run, schema)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = 6_000, folds: int = 4, least: int = 3, most: float = 0.3) -> list[Linear]:
    """The chain, fitted in the driver on the bounded sample, by features in `least` rows or more and at most a share `most` of them."""
    import pyarrow as pa

    got = training_rows(docs, labels, categories, sample).toArrow()
    if not got.num_rows:
        return [Linear(np.zeros(WIDTH, np.float32), np.zeros(i), -30.0, math.inf) for i in range(len(categories))]
    labelled, fold = np.column_stack([got[c].to_numpy() for c in categories]), got["fold"].to_numpy()
    order = np.lexsort((*labelled.T, fold))  # tasks end in any order
    index, value = (got[c].combine_chunks() for c in ("index", "value"))
    del got
    rows = Rows.of(index.flatten().to_numpy(), value.flatten().to_numpy(), index.value_lengths().to_numpy(), order, least, most)
    del index, value
    pa.default_memory_pool().release_unused()
    return fit_chain(rows, labelled[order], fold[order] % folds, folds)


class Scorer:
    """Scores texts by the chain; sums of words' weights are cached."""

    def __init__(self, models: list[Linear]):
        self.models, self.parts = models, {}
        self.stack = np.stack([m.weights for m in models])

    def part(self, word: str) -> tuple[float, ...]:
        found = self.parts.get(word)
        if found is None:
            if len(self.parts) > CACHE:
                self.parts.clear()
            found = self.parts[word] = tuple(self.stack[:, word_features(word)].sum(axis=1).tolist())
        return found

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        dots = np.zeros((len(texts), len(self.models)))
        for i, text in enumerate(texts):
            text = text or ""
            found = WORDS.findall(text)
            distinct = {x.lower() for x in found}
            sums = [math.fsum(x) for x in zip(*map(self.part, distinct), strict=True)] if distinct else [0.0] * len(self.models)
            dots[i] = np.array(sums) / math.sqrt(max(1, len(distinct))) + 0.3 * self.stack[:, text_shares(text, found, len(distinct))].sum(axis=1)
        earlier, out = np.zeros((len(texts), 0)), []
        for c, model in enumerate(self.models):
            out.append(sigmoid(model.logit(dots[:, c], earlier)))
            earlier = np.column_stack([earlier, as_input(out[-1])])
        return np.column_stack(out)


#: The categories in the order of the chain, as expressions over the labels: what earlier ones say helps the last.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def score(docs: DataFrame, models: list[Linear], categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """The rows of docs with a probability p_<category> for each category."""
    names = [f"p_{c}" for c in categories]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame(scorer(batch.tolist()), columns=names)

    fields = ", ".join(f"{n} double" for n in names)
    apply = F.pandas_udf(run, f"struct<{fields}>")
    taken = {c.lower() for c in docs.columns}
    hold = next(n for n in (f"_p{i}" for i in range(1000)) if n not in taken)
    scored = docs.withColumn(hold, apply(F.col("text").cast("string")))
    return scored.select(*docs.columns, *(F.col(f"{hold}.{n}").alias(n) for n in names if n.lower() not in taken))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """doc_id, the chain's probabilities and whether the document is toxic."""
    models = train(docs, labels, CATEGORIES, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(texts, models).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= models[-1].threshold).alias("toxic"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """The documents that aren't toxic, with the columns they had."""
    models = train(docs, labels, CATEGORIES, sample)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return score(rows, models).where(F.col("p_toxic") < models[-1].threshold).select("row.*")
