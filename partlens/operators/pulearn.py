"""Positive-unlabeled text classification: TF-IDF features, bags of logistic regressions, held-out and out-of-bag scores.

docs(id, text, label), a row for each id: label is P (positive), U (unlabeled) or N (labelled negative). A bag holds the
positives, the negatives and as many unlabeled rows as there are positives. Bags of up to FIRST rows are fitted in a task each;
where a bag has more, passes over the rows of all bags lead all models to the optimum over whole bags, so a task never holds more
than a batch, the models and a guide.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions import text as X
from partlens.session import written

from . import classify
from . import grams as G

#: Language of logic and driver chips, which negatives are weighted by, and of what is no flight part.
LOGIC = "cmos driver, cmos drivers, cmos logic, cmos buffer, cmos inverter, cmos translator, cmos receiver, level translator, level shifter, logic translator, logic shifter, voltage translator, voltage shifter, gate driver, line driver, clock driver, led driver, motor driver, display driver, relay driver, driver ic, driver array, octal driver, octal buffer, lvcmos, lvttl, hcmos, nand gate, nor gate, xor gate, flip flop, flipflop, shift register"
NO_FLIGHT = "eval, evaluation, kit, test board, demo, adapter, torque, wrench, hand held, handheld, carrying case, software, power supply"
SCALE = 1_000_000
#: Rows of a bag up to which it is fitted in one task; rows whose curvature guides the passes over all rows, and bytes of all guides' blocks; passes at most, after how many the guides are made anew, and again.
FIRST, GUIDES, GUIDED, PASSES, NEAR, AGAIN = 2_000, 65_536, 208_000_000, 500, 6, 40


def spoken(x: Column, terms: str) -> Column:
    """Whether the text has one of the terms as whole words."""
    line = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    return F.exists(F.array(*(F.lit(f" {t.strip()} ") for t in terms.split(","))), lambda t: F.contains(line, t))


def negative_weight(text: Column, weight: float = 3.0) -> Column:
    return F.when(spoken(text, LOGIC), float(weight)).otherwise(1.0)


def _grams(text: Column) -> Column:
    """Words and word pairs (kind w), and runs of 3 to 5 signs within words set in blanks (kind c)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, 2_000_000_000), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = F.flatten(F.flatten(F.transform(padded, lambda w: F.transform(F.array(*map(F.lit, (3, 4, 5))), lambda n: F.when(F.char_length(w) > n, F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: F.substr(w, i, n))).when((n == 3) | (F.char_length(w) == n), F.array(w)).otherwise(F.array().cast("array<string>"))))))
    kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("token"))
    return F.concat(F.transform(F.concat(words, pairs), kind("w")), F.transform(runs, kind("c")))


def counted(docs: DataFrame, stop: list[str] = ()) -> DataFrame:
    """id, kind, token, n: how often a document has each; stop words don't count as words of their own."""
    rows = docs.select("id", F.explode(_grams(F.coalesce("text", F.lit("")))).alias("g")).select("id", "g.kind", "g.token")
    if stop:
        rows = rows.where(~((F.col("kind") == "w") & F.col("token").isin(list(stop))))
    return rows.groupBy("id", "kind", "token").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, documents: int, most: int = 60_000, least: dict[str, int] = {"w": 2, "c": 3}) -> DataFrame:
    """index, kind, token, idf: of each kind the `most` frequent tokens that lie in enough documents."""
    by = counts.groupBy("kind", "token").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    kept = [by.where((F.col("kind") == k) & (F.col("df") >= d)).orderBy(F.desc("total"), "token").limit(most) for k, d in least.items()]
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.union(more)
    index = F.row_number().over(Window.orderBy("kind", "token")) - 1  # at most `most` rows of each kind
    return rows.select(index.cast("int").alias("index"), "kind", "token", (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, features (array of index, value): (1 + ln n) idf, each kind of a document scaled to length 1."""
    rows = counts.join(vocab, ["kind", "token"]).withColumn("v", (1 + F.log("n")) * F.col("idf"))
    size = rows.groupBy("id", "kind").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    rows = rows.join(size, ["id", "kind"]).select("id", F.struct("index", (F.col("v") / F.col("size")).cast("float").alias("value")).alias("f"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("f")).alias("features"))


def fit(index: np.ndarray, value: np.ndarray, begin: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 40) -> np.ndarray:
    """L2-regularised logistic regression (a penalised constant at the end) by Newton steps with conjugate gradients; memory grows with the non-zeros."""
    owner = np.repeat(np.arange(len(target)), np.diff(begin))
    times = lambda w: np.bincount(owner, value * w[index], len(target)) + w[-1]
    back = lambda r: np.append(np.bincount(index, value * r[owner], width), r.sum())
    loss = lambda w, z: 0.5 * w @ w + (weight * (np.logaddexp(0, z) - target * z)).sum()
    w = np.zeros(width + 1)
    z = times(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = w + back(weight * (p - target))
        if np.abs(grad).max() < 1e-6:
            break
        curve, step = weight * p * (1 - p), np.zeros_like(w)
        r = -grad
        d, size = r.copy(), r @ r
        for _ in range(60):
            turned = d + back(curve * times(d))
            a = size / (d @ turned)
            step += a * d
            r = r - a * turned
            new = r @ r
            if new < 1e-12 * (grad @ grad):
                break
            d, size = r + new / size * d, new
        change, scale, now = times(step), 1.0, loss(w, z)
        while loss(w + scale * step, z + scale * change) > now and scale > 1e-6:
            scale /= 2
        w, z = w + scale * step, z + scale * change
    return w


@dataclass
class Bundle:
    """What scoring new texts needs."""

    vocab: DataFrame
    weights: np.ndarray
    threshold: float
    priors: list[tuple[str, float]]
    prior_weight: float
    stop: tuple[str, ...] = ()

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        about = {"threshold": self.threshold, "priors": self.priors, "prior_weight": self.prior_weight, "stop": list(self.stop)}
        spark = self.vocab.sparkSession
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(self.weights)], "model int, weights array<double>").write.mode("overwrite").parquet(f"{path}/models")
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        weights = np.array([r.weights for r in spark.read.parquet(f"{path}/models").orderBy("model").collect()])
        return cls(spark.read.parquet(f"{path}/vocabulary"), weights, about["threshold"], [tuple(p) for p in about["priors"]], about["prior_weight"], tuple(about["stop"]))


def prior(text: Column, priors: list[tuple[str, float]]) -> Column:
    """Sum of the log odds of the expressions found."""
    total = F.lit(0.0)
    for pattern, weight in priors:
        total += F.when(F.rlike(text, F.lit(f"(?i){pattern}")), float(weight)).otherwise(0.0)
    return total


def probabilities(rows: DataFrame, weights: np.ndarray, name: str) -> DataFrame:
    """rows(id, features, ...) with an array of each model's probability. The models' table has models x features numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T.astype(np.float32)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in batches:
            out = []
            for own in batch:
                z = table[-1].astype(np.float64)
                if own is not None and len(own):
                    z = z + np.array([f["value"] for f in own], np.float32) @ table[[f["index"] for f in own]]
                out.append((1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist())
            yield pd.Series(out)

    return rows.withColumn(name, F.pandas_udf(run, "array<double>")(F.col("features")))


def _share(id_: Column, *salt: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("string"), *map(F.lit, salt)), F.lit(SCALE)) / float(SCALE)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _shares(batch: pa.RecordBatch, balance: np.ndarray, drawn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """1 for positives, and each row's weight in each bag (0 outside; with drawn, unlabeled rows count in all bags by the share that was drawn)."""
    label = np.array(batch.column("label").to_pylist(), object)
    target = (label == "P").astype(np.int64)
    member = batch.column("member").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, balance.shape[0])
    if drawn is not None:
        member[label == "U"] = drawn
    return target, member * batch.column("weight").to_numpy()[:, None] * balance.T[target]


def _slopes(rows: DataFrame, kind: str, weights: np.ndarray, which: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of some models over their whole bags, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((weights[which], which, balance))

    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        w, which, balance = shared.value
        loss, grad, room = np.zeros(len(w)), np.zeros(w.shape), []
        for batch in batches:
            target, share = _shares(batch, balance)
            for part, x in G.tables(batch, kind, w.shape[1] - 1, room):
                z, t, own = x @ w.T, target[part, None], share[part][:, which]
                loss += (own * (np.logaddexp(0, z) - t * z)).sum(0)
                grad += (own * (_sigmoid(z) - t)).T @ x
        return np.concatenate([loss, grad.ravel()]).tobytes()

    out = sum(np.frombuffer(x) for x in G.gathered(rows, run))
    shared.destroy()
    w = weights[which]
    return out[: len(w)] + 0.5 * (w * w).sum(1), out[len(w) :].reshape(w.shape) + w


def _inverse(low: np.ndarray) -> np.ndarray:
    """Of a lower triangle, by halves."""
    n = len(low)
    if n <= 128:
        return np.linalg.inv(low)
    k, out = n // 2, np.zeros_like(low)
    out[:k, :k], out[k:, k:] = _inverse(low[:k, :k]), _inverse(low[k:, k:])
    out[k:, :k] = -out[k:, k:] @ (low[k:, :k] @ out[:k, :k])
    return out


class Guide:
    """About the inverse curvature of some models: a block of features as the root of its inverse, in parts of BAND rows of its lower triangle, the others one by one. It only shortens the way."""

    BAND = 64

    def __init__(self, top: np.ndarray, parts: list[bytes], diagonal: np.ndarray) -> None:
        self.top, self.diagonal = top, diagonal
        self.parts = [np.frombuffer(x, np.float32).reshape(-1, min(len(top), (i + 1) * self.BAND)) for i, x in enumerate(parts)]

    def __call__(self, q: np.ndarray) -> np.ndarray:
        out, own = q * self.diagonal, q[self.top].astype(np.float32)
        turned = np.zeros_like(own)
        for x in self.parts:
            turned[: x.shape[1]] += x.T @ (x @ own[: x.shape[1]])
        out[self.top] = turned
        return out


def _guides(rows: DataFrame, kind: str, weights: np.ndarray, balance: np.ndarray, drawn: np.ndarray, bags: int, share: float) -> list[Guide]:
    """A guide for each fold's bags at their models, from a share of the rows, each fold's by a task that holds a batch and two blocks. Unlabeled rows stand for those that the bags drew."""
    folds, width = len(weights) // bags, weights.shape[1] - 1
    dense = min(width + 1, int(np.sqrt(GUIDED / (4 * folds))))
    sample = rows if share == 1 else rows.where(_share(F.col("id"), -1) < share)
    top = np.arange(width + 1)
    if dense <= width:
        most = sum(np.frombuffer(x) for x in G.gathered(sample.select("index", "value"), lambda batches: _squares(batches, kind, width)))
        top = np.sort(np.append(np.argsort(-most, kind="stable")[: dense - 1], width))
    shared = rows.sparkSession.sparkContext.broadcast((weights, balance, drawn, top))

    def of(fold: int) -> Guide:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, balance, drawn, top = shared.value
            own = slice(fold * bags, (fold + 1) * bags)
            w, room, every = weights[own], [], len(top) == width + 1
            block, diagonal = np.zeros((len(top), len(top)), np.float32), np.zeros(width + 1)
            for batch in batches:
                target, bent = _shares(batch, balance, drawn)
                for part, x in G.tables(batch, kind, width, room):
                    p = _sigmoid(x @ w.T)
                    bend = (bent[part][:, own] * p * (1 - p)).mean(1) / share
                    if not every:
                        diagonal += bend @ (x * x)
                    some = ((x if every else x[:, top]) * np.sqrt(bend)[:, None]).astype(np.float32)
                    block += some.T @ some
            block[np.diag_indices_from(block)] += 1 + 1e-6 * block.diagonal().max(initial=0)
            block = _inverse(np.linalg.cholesky(block))
            parts = [(1 / (1 + diagonal)).tobytes(), *(np.ascontiguousarray(block[at : at + Guide.BAND, : at + Guide.BAND]).tobytes() for at in range(0, len(top), Guide.BAND))]
            for i, x in enumerate(parts):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "x": pa.array([x], pa.binary())})

        some = sample.where((F.col("label") == "U") | F.exists(F.slice("member", fold * bags + 1, bags), lambda x: x)).drop("id")
        told = [r.x for r in sorted(some.coalesce(1).mapInArrow(run, "i int, x binary").collect(), key=lambda r: r.i)]
        return Guide(top, told[1:], np.frombuffer(told[0]))

    guides = [of(fold) for fold in range(folds)]  # one after the other, so that the driver holds one that arrives
    shared.destroy()
    return guides


def _squares(batches: Iterator[pa.RecordBatch], kind: str, width: int) -> bytes:
    out = np.zeros(width)
    for batch in batches:
        _, index, value = G.unpacked(batch, kind)
        out += np.bincount(index, value.astype(float) ** 2, width)
    return out.tobytes()


def _settled(rows: DataFrame, space: G.Space, balance: np.ndarray, drawn: np.ndarray, bags: int, count: int) -> np.ndarray:
    """The models at the optimum over their whole bags: quasi-Newton steps of all side by side, a pass over the rows each, until no slope is left. Guides are made anew where the models have come near."""
    kind, every = space.numbers, np.arange(len(balance))
    w = np.zeros((len(every), space.width + 1))
    kept = int(max(2, min(40, 2e7 // w.size)))
    passes = rows.drop("id")
    loss, grad = _slopes(passes, kind, w, every, balance)
    steps, size, done, guides = [[] for _ in every], np.ones(len(every)), np.abs(grad).max(1) < 1e-6, []

    def way(j: int) -> np.ndarray:
        q, used = grad[j].copy(), []
        for s, y in reversed(steps[j]):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        out = guides[j // bags](q)
        for (s, y), a in zip(steps[j], reversed(used), strict=True):
            out += (a - (y @ out) / (s @ y)) * s
        return -out

    for turn in range(PASSES):
        which = every[~done]
        if not len(which):
            return w
        if turn == 0 or turn % AGAIN == NEAR:
            guides.clear()
            guides += _guides(rows, kind, w, balance, drawn, bags, min(1.0, GUIDES * (0.3 if turn == 0 else 1) / count))
            steps, size = [[] for _ in every], np.ones(len(every))
        move = {j: way(j) for j in which}
        trial = w.copy()
        for j in which:
            trial[j] += size[j] * move[j]
        new, slope = _slopes(passes, kind, trial, which, balance)
        for i, j in enumerate(which):
            if new[i] <= loss[j] + 1e-4 * size[j] * (grad[j] @ move[j]) + 1e-10 * abs(loss[j]):
                s, y = trial[j] - w[j], slope[i] - grad[j]
                if s @ y > 0:
                    steps[j] = [*steps[j], (s, y)][-kept:]
                w[j], loss[j], grad[j], size[j] = trial[j], new[i], slope[i], 1.0
                done[j] = np.abs(grad[j]).max() < 1e-6
            else:
                size[j] /= 2
                done[j] = size[j] < 1e-6
    raise RuntimeError(f"{(~done).sum()} models have slopes up to {np.abs(grad).max():.2g} left after {PASSES} passes")


def _each(rows: DataFrame, kind: str, weights: np.ndarray) -> DataFrame:
    """rows with an array of each model's probability."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    keep = [c for c in rows.columns if c not in ("index", "value")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, room = shared.value, []
        for batch in batches:
            p = np.zeros((batch.num_rows, len(w)))
            for part, x in G.tables(batch, kind, w.shape[1] - 1, room):
                p[part] = _sigmoid(x @ w.T)
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * len(w)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(at, p.ravel())], names=[*keep, "each"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, each array<double>")


def train(docs: DataFrame, bags: int = 15, folds: int = 5, seed: int = 0, recall: float = 0.9, priors: list[tuple[str, float]] = (), prior_weight: float = 1.0, most: int = 60_000, stop: tuple[str, ...] = (), logic_weight: float = 3.0, bag_fraction: float = 0.5) -> tuple[DataFrame, Bundle]:
    """Predictions (id, label, score, qualifiable) and the bundle of the final models.

    Positives and labelled negatives are scored by models of the folds that don't hold them, unlabeled rows by the bags that
    didn't draw them (by the final models if all did). The threshold reaches `recall` of the held-out positives, after the
    prior is blended in.
    """
    with G.small_batches(docs.sparkSession):
        return _train(docs, bags, folds, seed, recall, priors, prior_weight, most, stop, logic_weight, bag_fraction)


def _train(docs, bags, folds, seed, recall, priors, prior_weight, most, stop, logic_weight, bag_fraction) -> tuple[DataFrame, Bundle]:
    spark = docs.sparkSession
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), "label")
    sizes = {r["label"]: r["n"] for r in docs.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, n, u = (sizes.get(x, 0) for x in "PNU")
    if not p or not (n or u):
        raise ValueError("positives, and negatives or unlabeled rows are needed")
    weight = F.when(F.col("label") == "N", negative_weight(F.col("text"), logic_weight)).otherwise(F.lit(1.0))
    told = docs.select("id", "text", "label", weight.alias("weight"), prior(F.col("text"), list(priors)).alias("prior"))
    rows, tokens, learned = G.learned(told, p + n + u, most, tuple(stop))
    space = G.Space(tokens, learned)
    vocab = written(spark.createDataFrame(learned, "index int, kind string, token string, idf double"), "vocabulary")
    width = space.width
    folds = max(2, min(folds, p, n if n else folds))
    of_fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(folds))
    plans = [(f, b) for f in range(folds + 1) for b in range(bags)]  # the last fold holds nothing out: the final models

    def member(f: int, b: int) -> Column:
        left = 1.0 if f == folds else 1 - 1 / folds
        want = max(1.0, left * (p - n))
        share = want / u if u and want < u else bag_fraction
        return F.when(F.col("label") == "U", _share(F.col("id"), seed, f, b) < share).otherwise(of_fold != f)

    held = written(space.features(rows.withColumn("member", F.array(*(member(f, b) for f, b in plans)))), "features", "zstd")
    work = held.where(F.exists("member", lambda x: x)).select("id", "label", "weight", "index", "value", "member")
    count = lambda test: [F.count_if(test & F.get("member", i)) for i in range(len(plans))]
    good = F.col("label").eqNullSafe("P")
    told = work.agg(F.count("*"), *count(~good), *count(good), *count(F.col("label") == "U")).first()
    of_class = np.array(told[1 : 1 + 2 * len(plans)], float).reshape(2, -1).T
    full = of_class.sum(1)
    balance = full[:, None] / (2 * np.maximum(1, of_class))  # both classes weigh alike
    shared, kind = spark.sparkContext.broadcast(balance), space.numbers

    def run(part: pa.Table) -> pa.Table:
        plan = part.column("plan")[0].as_py()
        batch = part.combine_chunks().to_batches()[0]
        row, index, value = G.unpacked(batch, kind)
        target = (np.array(batch.column("label").to_pylist(), object) == "P").astype(float)
        weight = batch.column("weight").to_numpy() * shared.value[plan][target.astype(int)]
        begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(target)))])
        w = fit(index, value.astype(float), begin, target, weight, width)
        return pa.table({"plan": pa.array([plan], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    if full.max() <= FIRST:
        begun = work.select("label", "weight", "index", "value", F.posexplode("member").alias("plan", "taken")).where("taken").drop("taken")
        fitted = {r["plan"]: np.frombuffer(r["w"]) for r in begun.groupBy("plan").applyInArrow(run, "plan int, w binary").collect()}
        weights = np.array([fitted.get(i, np.zeros(width + 1)) for i in range(len(plans))])
    else:
        weights = _settled(work, space, balance, np.array(told[1 + 2 * len(plans) :]) / max(1, u), bags, told[0])
    scored = _each(held.select("id", "label", "prior", "member", "index", "value"), kind, weights)
    last = folds * bags
    outside = F.filter(F.transform("each", lambda x, i: F.when((i < last) & ~F.get("member", i), x)), lambda x: x.isNotNull())
    final = F.slice("each", last + 1, bags)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    score = F.when(F.size(outside) > 0, mean(outside)).otherwise(mean(final))
    blended = classify.blend_prior(score, F.col("prior"), prior_weight)
    scored = written(scored.select("id", "label", blended.alias("score")), "scores")
    threshold = classify.recall_threshold(scored, recall).first()[0]
    bundle = Bundle(vocab, weights[last:], threshold, list(priors), prior_weight, tuple(stop))
    return scored.select("id", "label", "score", (F.col("score") >= threshold).alias("qualifiable")), bundle


def score(texts: DataFrame, bundle: Bundle) -> DataFrame:
    """texts(id, text) with the mean probability of the final models, the prior blended in, and whether it reaches the threshold."""
    counts = counted(texts, bundle.stop)
    rows = texts.select("id", "text").join(weighted(counts, bundle.vocab), "id", "left")
    each = probabilities(rows, bundle.weights, "each")
    mean = F.aggregate("each", F.lit(0.0), lambda a, v: a + v) / F.size("each")
    blended = classify.blend_prior(mean, prior(F.coalesce("text", F.lit("")), bundle.priors), bundle.prior_weight)
    return each.select("id", blended.alias("score"), (blended >= bundle.threshold).alias("qualifiable"))


def top_features(bundle: Bundle, n: int = 25) -> DataFrame:
    """token, weight: the tokens that push most either way, by the mean of the models."""
    mean = bundle.weights[:, :-1].mean(axis=0)
    ends = np.unique(np.concatenate([np.argsort(mean)[:n], np.argsort(-mean)[:n]]))
    told = bundle.vocab.sparkSession.createDataFrame([(int(i), float(mean[i])) for i in ends], "index int, weight double")
    return bundle.vocab.join(F.broadcast(told), "index").select("token", "kind", "weight").orderBy(F.desc("weight"))


def leaks(features: DataFrame, words: str) -> DataFrame:
    """Features that read the label off the text: positive ones with one of the words."""
    return features.where((F.col("weight") > 0) & F.rlike("token", F.lit(f"(?i){words}")))


def interleaved(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs(id, label, words) in the order P, U, P, U ...: unlabeled rows shuffled by a hash, both classes in every prefix; what isn't a flight part is marked."""
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id"))
    marked = docs.withColumn("turn", turn).withColumn("sanity_negative", (F.col("label") == "U") & spoken(F.col("words"), NO_FLIGHT))
    return marked.orderBy("turn", "label")


def review_queue(preds: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged rows that aren't known positives, best first, with an empty verdict to fill in."""
    rows = preds.where(F.col("qualifiable") & F.col("label").isin("U", "N")).orderBy(F.desc("score"), "id").withColumn("verdict", F.lit(""))
    return rows.limit(limit) if limit else rows


def missed(preds: DataFrame) -> DataFrame:
    return preds.where(~F.col("qualifiable") & (F.col("label") == "P")).orderBy(F.desc("score"), "id")


def reviewed(rows: DataFrame, flagged: int, recall: float) -> DataFrame:
    """reviewed(verdict): judged, right, precision with its interval, and what that means for all flagged and all unlabeled rows."""
    from partlens.functions.numbers import wilson

    word = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    yes, no = word.isin("y", "yes", "true"), word.isin("n", "no", "false")
    out = rows.agg(F.count_if(yes | no).alias("judged"), F.count_if(yes).alias("right"))
    low, high = wilson(F.col("right"), F.col("judged"))
    share = F.coalesce(F.try_divide(F.col("right"), F.col("judged")), F.lit(0.0))
    out = out.withColumn("precision", share).withColumn("low", low).withColumn("high", high).withColumn("finds", F.col("precision") * flagged)
    return out.withColumn("in_unlabeled", F.try_divide(F.col("finds"), F.lit(float(recall)))) if recall else out.withColumn("in_unlabeled", F.lit(None).cast("double"))


def with_text(items: DataFrame, texts: DataFrame, least: int = 40, terms: list[str] = ()) -> DataFrame:
    """items(id) with their text, masked; those with too little text to judge are left out."""
    rows = items.join(texts, "id").where(F.char_length(F.trim("text")) >= least)
    return rows.withColumn("text", X.masked(F.col("text"), list(terms))) if terms else rows


def without_tables(text: Column, most: int | None = None) -> Column:
    """The text without lines of figures: those with under three letters, or under a quarter of letters."""
    letters = lambda line: F.char_length(F.regexp_replace(line, "[^A-Za-z]", ""))
    kept = F.filter(F.split(text, "\n"), lambda line: (letters(line) >= 3) & (letters(line) >= 0.25 * F.char_length(F.trim(line))))
    joined = F.array_join(kept, "\n")
    return F.substring(joined, 1, most) if most else joined
