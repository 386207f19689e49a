"""Training from positive and unlabeled texts, on made-up blurbs with known hidden positives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.operators import classify
from partlens.operators import grams as G
from partlens.operators import pulearn as L

GOOD = ["hermetic ceramic package with gold wire bonds", "bare die, thin film on alumina, screened lot", "sealed kovar housing, burn in and fine leak test"]
PLAIN = ["plastic overmold package, low cost", "commercial grade, moulded epoxy, tape and reel", "consumer module with plastic cover"]
FILLER = "gain noise figure band output return loss supply current typical value part series amplifier switch filter coupler".split()


def blurb(draw, good):
    return f"Model X-{draw.randrange(10**6)}\n{draw.choice(GOOD if good else PLAIN)}\n{' '.join(draw.sample(FILLER, 8))}"


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    rows = [(f"P{i}", blurb(draw, True), "P") for i in range(40)] + [(f"U{i}", blurb(draw, i < 20), "U") for i in range(160)]
    return spark.createDataFrame(rows, "id string, text string, label string").repartition(4).cache()


@pytest.fixture(scope="module")
def trained(docs):
    return L.train(docs, bags=4, folds=3, priors=[("hermetic", 0.5)])


def test_hidden_positives_are_found(trained):
    preds, bundle = trained
    rows = {r.id: r for r in preds.collect()}
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows.values())
    hidden = [rows[f"U{i}"].qualifiable for i in range(20)]
    others = [rows[f"U{i}"].qualifiable for i in range(20, 160)]
    assert sum(hidden) >= 17 and sum(others) <= 7
    assert sum(rows[f"P{i}"].qualifiable for i in range(40)) >= 36
    m = classify.pu_metrics(preds, bundle.threshold).first()
    assert m.recall >= 0.9 and 0.08 <= m.flag_rate <= 0.2


def test_saved_models_score_new_texts(spark, trained, tmp_path):
    _, bundle = trained
    bundle.save(str(tmp_path))
    again = L.Bundle.load(spark, str(tmp_path))
    draw = random.Random(9)
    texts = spark.createDataFrame([(i, blurb(draw, i < 10)) for i in range(20)] + [(20, ""), (21, None)], "id long, text string")
    got = {r.id: r for r in L.score(texts, again).collect()}
    assert len(got) == 22 and sum(got[i].qualifiable for i in range(10)) >= 9 and not any(got[i].qualifiable for i in range(10, 20))
    tokens = [r.token for r in L.top_features(again, 30).where("weight > 0").collect()]
    assert any("hermetic" in t or "die" in t or "seal" in t for t in tokens)
    assert L.leaks(L.top_features(again, 30), "hermetic|sealed|die").count() > 0


def test_features_against_a_loop(spark):
    rows = [(1, "Aa bb aa"), (2, "aa bb cc"), (3, "cc dd"), (4, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    counts = L.counted(docs)
    got = {(r.id, r.token): r.n for r in counts.where("kind = 'w'").collect()}
    assert got[1, "aa"] == 2 and got[1, "aa bb"] == 1 and got[1, "bb aa"] == 1 and got[3, "cc dd"] == 1 and (1, "bb cc") not in got
    assert {r.token for r in counts.where("kind = 'c' AND id = 3").collect()} == {" cc", "cc ", " cc ", " dd", "dd ", " dd "}
    vocab = L.vocabulary(counts, 4, least={"w": 2, "c": 3})
    idf = {(r.kind, r.token): r.idf for r in vocab.collect()}
    assert set(idf) == {("w", "aa"), ("w", "bb"), ("w", "cc"), ("w", "aa bb")}
    assert math.isclose(idf["w", "aa"], math.log(5 / 3) + 1)
    index = {r["index"]: r.token for r in vocab.collect()}
    own = {index[f["index"]]: f["value"] for f in L.weighted(counts, vocab).where("id = 1").first().features}
    raw = {"aa": (1 + math.log(2)) * idf["w", "aa"], "bb": idf["w", "bb"], "aa bb": idf["w", "aa bb"]}
    size = math.sqrt(sum(v * v for v in raw.values()))
    assert own == pytest.approx({k: v / size for k, v in raw.items()}, rel=1e-6)


def test_logistic_regression_is_at_its_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 5)) * (draw.random((60, 5)) < 0.7)
    y, s = (x[:, 0] + 0.3 * draw.normal(size=60) > 0).astype(float), draw.uniform(0.5, 2, 60)
    row, col = np.nonzero(x)
    begin = np.concatenate([[0], np.cumsum((x != 0).sum(1))])
    w = L.fit(col, x[row, col], begin, y, s, 5)
    full = np.column_stack([x, np.ones(60)])
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(w + full.T @ (s * (p - y))).max() < 1e-5


def test_queue_review_and_weights(spark, trained):
    preds, _ = trained
    queue = L.review_queue(preds, 5).collect()
    assert len(queue) == 5 and [r.score for r in queue] == sorted((r.score for r in queue), reverse=True) and {r.label for r in queue} == {"U"}
    assert all(not r.qualifiable for r in L.missed(preds).collect())
    items = spark.createDataFrame([(i, "P" if i < 3 else "U", "Eval Kit 7" if i == 4 else "mixer") for i in range(8)], "id long, label string, words string")
    order = L.interleaved(items).collect()
    assert [r.label for r in order] == ["P", "U"] * 3 + ["U", "U"] and [r.id for r in order if r.sanity_negative] == [4]
    verdicts = spark.createDataFrame([("y",), ("Yes",), ("n",), ("",), (None,), ("TRUE",)], "verdict string")
    r = L.reviewed(verdicts, 40, 0.8).first()
    assert (r.judged, r.right, r.precision, r.finds, r.in_unlabeled) == (4, 3, 0.75, 30.0, 37.5)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(L.negative_weight(F.lit("an octal buffer"))) == 3.0 and one(L.negative_weight(F.lit("a mixer"))) == 1.0
    assert one(L.without_tables(F.lit("words here\n12 34 56 V\nok 1 2 3 4 5 6 7 8 9 10 11\nmore words"))) == "words here\nmore words"


def test_needs_both_kinds(spark):
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([("a", "x", "U")], "id string, text string, label string"))


def test_packed_features_against_rows_of_tokens(spark, monkeypatch):
    odd = ["", None, "  ", "a", "ab\u00e9 \u00b2x e\u0301te\u0301 \u24d0b x_1 12 3", "nul\0 nul\0 \0", "\U0001f600\U0001f600 \u4e2d\u6587 \u4e2d\u6587\u5b57", "x-ray, x-ray; X-RAY's", "the the the the the"]
    draw = random.Random(3)
    texts = odd * 2 + [" ".join(draw.choice(FILLER) for _ in range(draw.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3).cache()
    counted = L.counted(docs, ["gain"])
    for most, told in ((12, 5), (60_000, 50_000)):
        monkeypatch.setattr(G, "TOLD", told)
        vocab = L.vocabulary(counted, len(texts), most)
        want = {r["index"]: (r.kind, r.token, pytest.approx(r.idf)) for r in vocab.collect()}
        rows, tokens, learned = G.learned(docs, len(texts), most, ("gain",))
        assert {i: x for i, *x in map(tuple, learned)} == {i: list(x) for i, x in want.items()}
        space, got = G.Space(tokens, learned), {}
        for batch in rows.toArrow().to_batches():
            ids = batch.column("id").to_pylist()
            for row, index, value in zip(*space(batch), strict=True):
                got.setdefault(ids[row], {})[int(index)] = value
        assert got == {r.id: {f["index"]: pytest.approx(f["value"], rel=1e-6) for f in r.features} for r in L.weighted(counted, vocab).collect()}
    assert G.totals_of_runs({"ab": 2, "b\0": 1, "": 4}) == {" ab": 2, "ab ": 2, " ab ": 2, " b\0": 1, "b\0 ": 1, " b\0 ": 1}


def test_whole_bags_by_passes_and_no_rows_of_tokens(docs, monkeypatch):
    one = {r.id: r.score for r in L.train(docs, bags=2, folds=2, most=300)[0].collect()}
    made, write = [], L.written
    for module in (L, G):
        monkeypatch.setattr(module, "written", lambda *a: made.append(write(*a)) or made[-1])
    for name, rows in (("FIRST", 20), ("GUIDES", 40), ("DENSE", 100)):
        monkeypatch.setattr(L, name, rows, raising=False)
    many = {r.id: r.score for r in L.train(docs, bags=2, folds=2, most=300)[0].collect()}
    assert many == {k: pytest.approx(v, abs=1e-6) for k, v in one.items()}
    assert max(x.count() for x in made) < 15_000  # a row for each token of each text made more


def test_few_passes_reach_whole_bags_with_a_guide_for_some_features(docs, monkeypatch):
    one = {r.id: r.score for r in L.train(docs, bags=2, folds=2, most=300)[0].collect()}
    monkeypatch.setattr(L, "FIRST", 20)
    for most, name, bytes_ in ((24, "GUIDED", 208_000_000), (120, "GUIDED", 4 * 3 * 150**2)):
        monkeypatch.setattr(L, name, bytes_, raising=False)
        monkeypatch.setattr(L, "PASSES", most)
        many = {r.id: r.score for r in L.train(docs, bags=2, folds=2, most=300)[0].collect()}
        assert many == {k: pytest.approx(v, abs=1e-6) for k, v in one.items()}
