"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.llm import common, decontamination, graph, html, licenses, neardup, neighbours, ordering, packing, pii, queries, toxicity, urls
from partlens.llm.graph import components
from partlens.llm.tokens import Encoder, vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))


@pytest.fixture(scope="module")
def texts(spark, small):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    extra = ["", None, "!!", "one two", "One, two", "a " * 3000 + "b", "Éa éa 日本 x y z w", "mail a@b.co or 10.0.0.1, +1 (487) 555-7209, under the MIT License"]
    return own + [(100_000 + i, t) for i, t in enumerate(extra)] + [own[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns with names that operators use themselves
    rows = [(i, t, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, rep long").repartition(4)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("hub", [100_000, 5])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (None, 3)] + [(i % 5, i) for i in range(200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(41), *range(200, 300)]} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = collections.Counter(k for g in s for k in where[g] if k > i)
        for k, n in both.items():
            if n * 1.8 >= 0.8 * (len(s) + len(sets[k])) - 1e-9:
                links[i] += 1
                links[k] += 1
                root[max(top(i), top(k))] = min(top(i), top(k))
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(least.get(top(i), texts[i][0]), texts[i][0])
    return sorted((texts[i][0], least[top(i)], links[i]) for i in range(len(texts)))


def test_similarity_join(docs, texts):
    assert sorted(map(tuple, neardup.classes(docs).collect())) == brute_classes(texts)


def test_large_group_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = list(base)
        own[i % 60] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_classes(rows)


def test_keep_one(spark, docs, texts):
    want = {c for _, c, _ in brute_classes(texts)}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert neardup.keep_one(empty(spark)).count() == 0


def test_one_doc_id_with_different_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (3, three), (3, one + " end"), (4, ""), (4, three + " end"), (5, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, extra int").repartition(3)
    assert sorted(map(tuple, neardup.classes(docs).collect())) == brute_classes(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (1, two), (3, three), (4, ""), (5, "")])


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(x):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, x or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    listed = [s for _, _, s in sorted(out)]
    return (*(sum(s.startswith(k) for s in listed) for k in KINDS), hashlib.sha256(",".join(listed).encode()).hexdigest())


def test_personal_data(spark, texts):
    odd = ["a@b.c_d@e.f ..x@y.z-q", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 1  2", "+1 (487) 555-7209 +123 +49.30.1234567-", "9" * 3000, "1 2 " * 5000, "@" * 100 + "a" * 5000 + "@b"]
    rows = texts + [(200_000 + i, t) for i, t in enumerate(odd)]
    got = collections.defaultdict(set)
    for r in queries.pii_digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        got[r.doc_id].add((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        assert r.spans.count(":") >= 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone)
    assert got == {i: {brute_pii(t)} for i, t in rows}


def test_discovers_identifiers_by_context(spark):
    seeds = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and so on' for i in range(12)]
    unseen = "it was " + hashlib.sha1(b"unseen").hexdigest() + " that day"
    rows = list(enumerate([*seeds, unseen, "only 12 plain words in 2024"]))
    got = {r.doc_id: r.spans for r in queries.pii_digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[12] == "id:7:47" and got[13] == ""


def test_masks_assigned_and_long_values(spark):
    jwt = "eyJ" + "hb0cOi9JIUzI1.N-_" * 40 + "x"
    texts = ["password=hunter2x9", "export API_KEY=abc123def456 now", "see http://h.org/?token=0a1b2c3d&n=1", f"token: {jwt}", f"it said {jwt} again", "pwd=a1", "user1_password=zz99top", "x=y1 and a1=b2c3d4", "a=b " + "=" * 20_000, "the year a1"]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = ["password=[ID]", "export API_KEY=[ID] now", "see http://h.org/?token=[ID]&n=1", "token: [ID]", "it said [ID] again", "pwd=[ID]", "user1_password=[ID]", *texts[7:]]
    assert [got[i] for i in range(len(texts))] == want


def test_discovery_goes_on_until_nothing_is_added(spark):
    # shapes all differ, and each context holds 17 of the last one's 20 values and 3 new ones
    values = ["q" + "7q" * (3 + i) for i in range(38)]
    rows = [f'token = "{v}" ok' for v in values[:20]]
    for k, word in enumerate(["alpha", "beta", "gamma", "delta", "omega", "sigma"]):
        rows += [f"some {word} {v} ok" for v in values[3 * (k + 1) : 3 * (k + 1) + 20]]
    got = {r.doc_id: r.spans for r in queries.pii_digest(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    assert [i for i in range(len(rows)) if not got[i].startswith("id:")] == []


def test_many_spans_in_one_text(spark):
    """40 000 addresses take seconds, and where they lie is right over all blocks."""
    long = "É " + " ".join(f"u{i}@h{i}.org, 10.0.{i % 256}.{i % 9}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long, 0), (2, "a@b.co", 0), (3, None, 0)], "doc_id long, text string, key int")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.pii_digest(pii.find(docs)).collect()}
    assert got == {i: brute_pii(t) for i, t in [(1, long), (2, "a@b.co"), (3, None)]} and time.perf_counter() - began < 60
    began = time.perf_counter()
    new = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert new == {1: "É " + " ".join(["[EMAIL], [IP]"] * 20_000), 2: "[EMAIL]", 3: None} and time.perf_counter() - began < 60
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs).columns == docs.columns


def test_masking_against_a_loop(spark):
    draw = np.random.default_rng(8)
    for n in (0, 1, 63, 64, 65, 300):
        text = "".join(chr(x) for x in draw.integers(0x20, 0x250, 1500))
        spans = sorted((int(s), int(s + w), int(k)) for s, w, k in zip(draw.integers(0, 1490, n), draw.integers(1, 9, n), draw.integers(0, 5, n), strict=True))
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += text[at:s] + f"[{pii.NAMES[k].upper()}]"
            at = max(at, e)
        rows = spark.createDataFrame([(text, [(*s, "") for s in spans])], f"t string, s {pii.SPAN}")
        assert rows.select(pii.masked(F.col("t"), F.col("s"))).first()[0] == out + text[at:]


def test_running(spark):
    for n in (0, 1, 64, 65, 200, 5000):
        x = np.random.default_rng(n).integers(-9, 9, n).tolist()
        row = spark.createDataFrame([(x,)], "x array<int>").select(common.running(F.col("x"), "int", lambda a, b: a + b).alias("s"), common.running(F.col("x"), "int", F.greatest).alias("m")).first()
        assert row.s == np.cumsum(x).tolist() and row.m == (np.maximum.accumulate(x).tolist() if n else [])


def test_masking_keeps_columns(docs):
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert got[100_007] == "mail [EMAIL] or [IP], [PHONE], under the MIT License" and got[100_001] is None and pii.mask(docs).columns == docs.columns


def test_toxicity_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    models = toxicity.train(docs.where("doc_id % 2 = 0"), labels, toxicity.CATEGORIES)
    held = toxicity.score(docs.where("doc_id % 2 = 1"), models).select("doc_id", "p_toxic").join(labels.withColumnRenamed("toxic", "said"), "doc_id").toPandas()
    flagged = held.p_toxic >= models[-1].threshold
    assert (flagged & (held.said == 0)).sum() <= 0.02 * (held.said == 0).sum()
    assert (flagged & (held.said == 1)).sum() >= 0.85 * (held.said == 1).sum()


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(docs, none).count() == docs.count() and toxicity.reject(docs, none).columns == docs.columns


def test_license_base(docs, texts):
    def brute(x):
        w, places = words(x), []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))

    for r in queries.license_digest(licenses.detect(docs)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(dict(texts)[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(("text", "labels"), [("licensed under the GNU Lesser General Public License, version 2.1.", "lgpl-2.1"), ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("mit freundlichen Grüßen", ""), ("the new license", "")])
def test_license_rules(spark, text, labels):
    assert queries.license_digest(licenses.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().labels == labels


def example(parsed, n):
    """A match of a parsed expression: of every choice the n-th one, in turn."""
    out = ""
    for kind, what in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += chr(what)
        elif name == "IN":
            signs = [chr(c) for k, x in what for c in (range(x[0], x[1] + 1) if str(k) == "RANGE" else [x])]
            out += signs[n % len(signs)]
        elif name == "SUBPATTERN":
            out += example(what[3], n)
        elif name == "BRANCH":
            out += example(what[1][n % len(what[1])], n)
        elif name == "MAX_REPEAT":
            out += example(what[2], n) * max(what[0], n % 2)
    return out


def test_license_prefilter_loses_nothing(spark):
    lines = {example(licenses.syntax.parse(r["pattern"]), n) for r in licenses.rules() for n in range(11)}
    own = ["Released under the GPLv2.", "distributed under the terms of the LGPLv3, see COPYING", "subject to the AGPLv3", "licensed under the FreeBSD license", "an open-source licence", "free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"]
    rows = [*own, *(f"x-y {x.upper() if i % 2 else x}, z" for i, x in enumerate(sorted(lines)))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got, want = ({r.doc_id: r for r in licenses.detect(docs, prefilter=p).collect()} for p in (True, False))
    assert got == want and sum(len(r.found) > 0 for r in want.values()) >= 0.98 * len(rows)
    assert [r.labels for r in queries.license_digest(licenses.detect(docs.where("doc_id < 6"))).orderBy("doc_id").collect()] == ["gpl-2", "lgpl-3", "agpl-3", "bsd-2-clause", "unknown-free", "gpl"]


def brute_licenses(text):
    """Detections by a loop over all rules."""
    line, found = " " + " ".join(words(text)) + " ", []
    for r in licenses.rules():
        for m in re.finditer(r["pattern"], line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, -(first + 1 + m[0].count(" ")), r["priority"], r["label"], r["confidence"]))
    kept = []
    for k, d in enumerate(sorted(found)):
        if not any(e[2] <= d[2] and -e[1] >= -d[1] for e in sorted(found)[:k]):
            kept.append(d)
    return kept


def test_licenses_against_a_loop(spark, texts):
    rows = texts + [(300_000, "Under the MIT License, version 2 of the GPL license. " * 40), (300_001, "the apache license version 2.0 license; the bsd license " * 150), (300_002, "the isc license " * 4000)]
    got = collections.defaultdict(set)
    for r in licenses.detect(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rules int")).collect():
        got[r.doc_id].add(tuple(tuple(d) for d in r.found))
    for doc, text in rows[:-1]:
        assert tuple(brute_licenses(text)) in got[doc]
    assert [len(x) for x in got[300_002]] == [4000] and licenses.detect(empty(spark)).count() == 0


def test_tokens_equal_the_tokenizers(texts):
    own = Encoder(vocabulary())
    odd = ["<|endoftext|> a\xa0b  c\td", "İx ﬁ é ́a don't we'll", "AB!! cd### ''s <x> 12a", " a\x1cb"]
    rows = [t for _, t in texts] + odd
    want = own.tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)
    for _ in range(2):
        assert [np.array(x.ids, "<u4").tobytes() for x in want] == own.encode(rows)


def test_differencing():
    assert sorted(map(sorted, packing.difference([8, 7, 6, 5, 4], 2))) in ([[0, 3], [1, 2, 4]], [[0, 2], [1, 3, 4]], [[0, 1], [2, 3, 4]], [[0, 3, 4], [1, 2]])
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 1000, 500).tolist()
    groups = packing.assign(sizes, 4096)
    assert sorted(i for g in groups for i in g) == list(range(500)) and max(sum(sizes[i] for i in g) for g in groups) <= 4096
    assert packing.assign([], 10) == [] and len(packing.assign([6, 6, 6], 10)) == 3


def test_packing_round_trip(spark, docs, texts):
    own = Encoder(vocabulary())
    got = collections.defaultdict(dict)
    filled = collections.defaultdict(list)
    for r in packing.pack(docs, capacity=256, piece=64, group=16).collect():
        got[r.doc_id].setdefault(r.start, set()).add(bytes(r.input_ids))
        filled[r.sequence_id].append((r.offset, r.length))
        assert r.length * 4 == len(r.input_ids)
    for doc, text in texts:
        ids = own.encode([text])[0] + (2).to_bytes(4, "little")
        assert b"".join(next(iter(got[doc][s])) for s in sorted(got[doc])) == ids
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty(spark)).count() == 0


def brute_hits(rows, items, length=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(length, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n, own in windows.items():
            for k in range(len(w) - n + 1):
                if s := own.get(tuple(w[k : k + n])):
                    found |= s
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, docs, texts):
    items = [(1, "one"), (2, "éa Éa"), (3, " ".join(f"a{i}" for i in range(30))), (4, None), (5, "!!"), (6, texts[5][1][:900]), (6, texts[6][1][:900]), (7, "a a a a a a a a a a a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.contaminated(docs, table).collect()} == want
    kept = decontamination.clean(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, n, _) in want.items() if not n}
    assert decontamination.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_decontamination_by_items_without_a_name(spark):
    rows = spark.createDataFrame([(1, "x " + " ".join(f"a{i}" for i in range(12))), (2, "so short it is"), (3, "clean")], "doc_id long, text string")
    table = spark.createDataFrame([(None, " ".join(f"a{i}" for i in range(12))), (None, "short it"), (5, "a0 a1")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.contaminated(rows, table).collect()}
    assert got == {1: (12, ["5"]), 2: (2, []), 3: (0, [])}
    assert [r.doc_id for r in decontamination.clean(rows, table).collect()] == [3]


@pytest.mark.parametrize("most", [0, 10**9])
def test_decontamination_by_either_join(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST", most)
    items = [(i, " ".join(words(texts[i][1])[3:25])) for i in range(8)] + [(9, "one two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.contaminated(docs, table).collect()}
    assert got == brute_hits(texts, items)


def test_decontamination_of_repeated_words_and_long_texts(spark):
    rows = [(1, "a " * 3000), (2, "a " * 3000), (3, "b " + "a " * 9 + "c " + "a " * 10), (4, " ".join(f"w{i % 5000}" for i in range(120_000))), (5, "x " * 12)]
    items = [(1, "a " * 400), (2, "a " * 12 + "b"), (3, " ".join(f"w{i}" for i in range(300, 420))), (4, "x x x")]
    docs, table = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, phrase int"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.contaminated(docs, table).collect()}
    assert got == brute_hits(rows, items)
    assert decontamination.clean(docs, table).columns == docs.columns and decontamination.contaminated(docs.limit(0), table).count() == 0


def test_urls(spark):
    rows = ["http://www.example.com/en/1", "https://EXAMPLE.com/en/", "https://a.example.com/EN/", "http://x.net/es/9?x", "http://x.net/es", "net/es/", None, "http://net/fr/", "http://free-bets.example.org/a", "http://freebets.org/a", "http://a.org/x.EXE?y", "http://com", "://com/"]
    want = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), ("com/", "allow")]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == want
    # the index fetches exactly the rules that match without it
    rules = [urls.host_rule(*r) for r in urls.HOST_RULES] + urls.patterns()
    for r, url in zip(got, rows, strict=True):
        rest = (url or "").partition("://")[2].translate(LOW)
        assert r.patterns == sorted(x.name for x in rules if x.kind == "pattern" and re.search(x.pattern, rest))


PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Menu</a></ul></nav><article><h1>T &lt;x&gt;</h1><p>Long  text,\nwith <b>marks</b>. More.<p>Second &eacute;<br>line.</article><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), (PAGE, "T <x>\n\nLong text, with marks. More.\n\nSecond é line."), ("<p>a < b &amp; c", "a < b & c"), ("<script>x</script><style>y</style><!-- z", ""),
     ("<div class='content'><p>A long paragraph, with signs, and more of them.</p></div><div class='comments'><p>Nice, really.</p></div><form>go</form><aside>side</aside>", "A long paragraph, with signs, and more of them.")],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


BODY = "A long paragraph of the body, with signs, and more of them than a teaser has; so it goes on, and on. " * 3


def test_an_article_does_not_silence_the_rest():
    body = BODY.strip()
    for page, times in [(f"<div><p>{BODY}</p><p>{BODY}</p></div><article class='card'>Short teaser</article>", 2), (f"<article>{f'<p>{BODY}</p>' * 5}</article><article><p>{BODY}</p></article><article>x</article>", 6)]:
        assert html.main_text(page) == "\n\n".join([body] * times)
    assert html.main_text(f"<article><h1>H</h1><p>{BODY}</p><table><tr><td>7</td></tr></table></article><div>me</div>") == f"H\n\n{body}\n\n7"


@pytest.mark.parametrize("tag", ['div class="wrapper has-sidebar"', 'main class="no-sidebar"', 'div id="page" class="header-fixed"', 'article class="post no-comments"'])
def test_a_name_does_not_veto_the_page(tag):
    inner = f"<div class='sidebar'><p>Latest, of all.</p></div><p>{BODY}</p><p>See <a href='/x'>here</a>, too.</p><div id='comments'><p>Nice.</p></div>"
    assert html.main_text(f"<{tag}>{inner}</{tag.split()[0]}><footer>f</footer>") == f"{BODY.strip()}\n\nSee here, too."
    assert html.main_text(f"<{tag}><article>{inner}</article></{tag.split()[0]}>") == f"{BODY.strip()}\n\nSee here, too."


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</ul>"
UNMARKED = [
    f"<div><div>{LINKS}</div><div><p>{BODY}</p><p>{BODY}</p></div><div><span>Top</span><span>Shop</span></div></div>",
    f"<table><tr><td>{LINKS}</td><td><p>{BODY}</p><p>{BODY}</p></td></tr></table>",
    f"<div><b>Sign in</b><i>Help</i></div><div><div><p>{BODY}</p><blockquote>{BODY}</blockquote></div></div>",
    f"<article><p>{BODY}</p><p>{BODY}</p></article><div><span>Top</span><b>Shop now</b></div>",
]


def brute_ratios(found):
    """The paths chosen, by the definition: length and signs per node, smoothed over neighbours of a part, fused, against a tenth of the mean."""
    keys, sums = html._keys(found), {}
    for k, (_, text) in zip(keys, found, strict=True):
        if not k[2]:
            n, chars, signs = sums.get(k, (0, 0, 0))
            sums[k] = n + 1, chars + len(text), signs + sum(c in ".,;:!?…。，！？" for c in text)
    order, fused = list(sums), {}
    for k in order:
        part = [x for x in order if x[1:] == k[1:]]
        at, ratios = part.index(k), []
        for value in (lambda x: sums[x][1] / sums[x][0], lambda x: (sums[x][2] + 1) / sums[x][0]):
            near = [(math.exp(-2 * (j - at) ** 2), value(part[j])) for j in (at - 1, at, at + 1) if 0 <= j < len(part)]
            ratios.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        fused[k] = ratios[0] * ratios[1]
    plain = dict(fused)
    for k in order:
        if k[0] and k[0][-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            fused[k] = plain[k] ** 0.125 * max(plain[x] for x in order if x[0][:-1] == k[0][:-1] and x[1:] == k[1:]) ** 0.875
    scores, sizes = {}, {}
    for k in order:
        own = [x for x in order if x[1] == k[1] and not x[4]]
        names = html.NAMED ** (k[3] + k[4])
        score = fused[k]
        if k[1] >= 0 and not k[4]:
            whole = sum(fused[x] * sums[x][1] for x in own) / sum(sums[x][1] for x in own)
            score = html.ARTICLE * fused[k] ** 0.125 * whole**0.875
        scores[k], sizes[k] = score * names, sums[k][1] * names
    mean = sum(scores[k] * sizes[k] for k in order) / sum(sizes.values()) if order else 0.0
    return {k for k in order if scores[k] >= 0.1 * mean}


def test_ratios_against_brute_force(spark, small):
    rows = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()] + UNMARKED + [PAGE]
    for page in rows:
        found = [(n, t) for n in html.nodes(page) if (t := "".join(n.parts)).strip()]
        assert html.content_paths(found)[1] == brute_ratios(found)


def test_ratios_decide(monkeypatch):
    """What no mark or name tells apart is told apart by the ratios; without them the texts are others."""
    want = "\n\n".join([BODY.strip()] * 2)
    assert [html.main_text(p) for p in UNMARKED] == [want] * 4
    assert html.main_text(f"<div>{LINKS}</div><div><p>{BODY}</p><h2>Part two</h2><p>{BODY}</p></div>") == f"{BODY.strip()}\n\nPart two\n\n{BODY.strip()}"
    monkeypatch.setattr(html, "_smoothed", lambda keys, values: [1.0] * len(keys))
    assert all(html.main_text(p) != want for p in UNMARKED)


def test_extraction_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.text == html.main_text(PAGE)) for r in got.collect()) == [(1, True), (1, True), (2, False)]


def test_probing_retrieves_every_code_within_the_radius():
    draw = np.random.default_rng(4)
    codes = np.packbits(draw.random((4000, 128)) < 0.5, axis=1)
    codes[1000:1400] = codes[0]  # a hot bucket in every substring
    codes[:3000] ^= np.packbits(draw.random((3000, 128)) < 0.08, axis=1)
    for radius in (0, 5, 16, 23, 40, 128):
        index, queries = neighbours.Index(codes, radius), codes[::200]
        apart = np.unpackbits(queries[:, None] ^ codes[None], axis=2).sum(axis=2)
        for own, rows in zip(apart, index.within(queries), strict=True):
            assert sorted(rows.tolist()) == np.flatnonzero(own <= radius).tolist()
        if radius <= 16:  # few codes are fetched
            assert index.marked(queries).mean() < 0.35
    assert {neighbours.Index(codes, r).bits for r in (5, 40)} == {8, 16}


def test_neighbours_recall_and_ties(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((1500, 32))
    x[700:720] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in [(5000, None), (5001, [0.0] * 32), (5050, [float("nan")] + [1.0] * 31), (5100, [1.0]), (5101, [2.0]), (5102, [-1.0]), (5150, [None] * 32)]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, width int")
    got = neighbours.search(table, F.col("vec_id") % 50 == 0).toPandas()
    n = np.sqrt((x * x).sum(1))
    near = x @ x.T / n[:, None] / n[None]
    np.fill_diagonal(near, -2)
    hit = 0
    for q in range(0, 1500, 50):
        best = np.lexsort((np.arange(1500), -np.round(near[q], 12)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        hit += len(set(best) & set(own.vec_id))
        assert np.allclose(own.score, near[q][own.vec_id], atol=1e-12)
    assert hit >= 0.9 * 150 and got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [700, 701, 702, 703, 704]
    assert got[got.query_id >= 5000].sort_values(["query_id", "rank"])[["query_id", "vec_id", "score"]].values.tolist() == [[5100, 5101, 1.0], [5100, 5102, -1.0]]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]
    assert neighbours.search(few.limit(0), F.lit(True)).count() == 0


def test_recall_against_brute_force_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(table, F.col("vec_id") % 50 == 0).collect()}
    all_rows = table.select("vec_id", "embedding").toPandas()
    ids, x = all_rows.vec_id.to_numpy(), neighbours.unit_rows(np.stack(all_rows.embedding.to_list()).astype(float))
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.lexsort((ids, -(x @ x[q]))) if ids[j] != ids[q]][:5]
        want |= {(ids[q], ids[j]) for j in order}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_permutation_is_a_bijection():
    for domain in (1, 2, 1000, 4097):
        assert sorted(ordering.permuted(np.arange(domain), domain, 9).tolist()) == list(range(domain))


def feistel(x, domain, key):
    """The slot of a number, by a plain loop."""
    def spread(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
        return h ^ h >> 33

    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x % 2**half
        for r in range(4):
            left, right = right, left ^ spread(right ^ (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64) % 2**half
        x = left << half | right
        if x < domain:
            return x


def test_training_order_against_a_loop(spark, texts, tmp_path):
    layout, own = ordering.Layout(length=128, records=50), Encoder(vocabulary())
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, shard string, slot int").coalesce(1)
    ids, first = [], []
    for r in docs.collect():  # one partition: the order of the rows
        new = [*np.frombuffer(own.encode([r.text])[0], "<u4").tolist(), 2]
        first += [(r.doc_id, k) for k in range(len(new))]
        ids += new
    count = -(-len(ids) // 128)
    assert ordering.write_shards(docs, path, layout, key=3, together=2) == count
    want = {feistel(n, count, 3): (*first[128 * n], ids[128 * n : 128 * (n + 1)]) for n in range(count)}
    got = ordering.read_slots(spark, path, layout).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.start, np.frombuffer(r.input_ids, "<u4").tolist()) for r in got] == [(s, *want[s]) for s in range(count)]
    assert [(r.shard, r.byte_offset) for r in got] == [(s // 50, s % 50 * layout.stride) for s in range(count)]
    for resume in (0, 49, 50, 77, count - 1):
        late = ordering.read_slots(spark, path, layout, first_slot=resume)
        assert sorted(r.slot for r in late.collect()) == list(range(resume, count))
        assert [(s, d, p, x.tolist()) for s, d, p, x in ordering.records_from(spark, path, layout, resume, at_once=7)] == [(s, *want[s]) for s in range(resume, count)]
    assert list(ordering.records_from(spark, path, layout, count)) == []
    sizes = sorted(f.stat().st_size for f in tmp_path.glob("shards/shard=*/part-*"))
    assert sizes[1:] == [50 * layout.stride] * (count // 50) and sizes[0] == (count % 50) * layout.stride


def test_training_order_of_partitions(spark, docs, texts, tmp_path):
    layout, own = ordering.Layout(length=128, records=64), Encoder(vocabulary())
    path = f"file://{tmp_path}/shards"
    count = ordering.write_shards(docs, path, layout, key=3)
    got = ordering.read_slots(spark, path, layout).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(count))
    ids = collections.Counter(x for r in got for x in np.frombuffer(r.input_ids, "<u4").tolist())
    want = collections.Counter()
    for _, t in texts:
        want.update([*np.frombuffer(own.encode([t])[0], "<u4").tolist(), 2])
    assert ids == want
    ordering.write_shards(docs, path + "2", layout, key=3)
    again = ordering.read_slots(spark, path + "2", layout).orderBy("slot").collect()
    assert [zlib.crc32(r.input_ids) for r in again] == [zlib.crc32(r.input_ids) for r in got]
    assert ordering.write_shards(empty(spark), path + "3", layout) == 0
    assert ordering.read_slots(spark, path + "3", layout).count() == 0 and list(ordering.records_from(spark, path + "3", layout)) == []


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on 1000 documents: what it keeps is exactly what brute force (for toxicity: the operator's verdict and the labels) says."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    before = rows(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = corpus_pipeline.written(stages["toxicity"](spark, docs, sf_dir), "toxicity")
    after = rows(docs)
    flagged = {r.doc_id for r in toxicity.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("toxic").collect()}
    assert after == [r for r in before if r[0] not in flagged] and docs.columns == columns
    kept = {i for i, _ in after}
    assert sum(i in kept for i, x in labels.items() if x == 0) >= 0.99 * sum(x == 0 for x in labels.values())
    assert sum(i not in kept for i, x in labels.items() if x == 1) >= 0.9 * sum(x == 1 for x in labels.values())
    before, docs = after, corpus_pipeline.written(stages["near_duplicates"](spark, docs, sf_dir), "near_duplicates")
    after, firsts = rows(docs), {c for _, c, _ in brute_classes(before)}
    assert after == [r for r in before if r[0] in firsts] and docs.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, docs = after, corpus_pipeline.written(stages["decontamination"](spark, docs, sf_dir), "decontamination")
    after, hits = rows(docs), brute_hits(before, items)
    assert after == [r for r in before if not hits[r[0]][1]] and len(after) < len(before) and docs.columns == columns
    before, docs = after, corpus_pipeline.written(stages["personal_data"](spark, docs, sf_dir), "personal_data")
    after = rows(docs)
    assert [i for i, _ in after] == [i for i, _ in before] and docs.columns == columns
    for (_, old), (_, new) in zip(before, after, strict=True):
        assert brute_pii(new)[:4] == (0, 0, 0, 0) if brute_pii(old)[:4] != (0, 0, 0, 0) else True
    got, own = collections.defaultdict(dict), Encoder(vocabulary())
    for r in stages["packing"](spark, docs, sf_dir).collect():
        got[r.doc_id][r.start] = bytes(r.input_ids)
    assert {i: b"".join(x[s] for s in sorted(x)) for i, x in got.items()} == {i: own.encode([t])[0] + (2).to_bytes(4, "little") for i, t in after}


def test_thin_evidence_flags_nothing():
    y = np.array([1] * 5 + [0] * 60)
    assert toxicity.best_threshold(np.linspace(1, 0, 65), y) < 1  # five of five: the lower bound is above a half
    assert toxicity.best_threshold(np.concatenate([[0.9, 0.8], np.full(63, 0.1)]), np.array([1, 0] + [0] * 63)) == float("inf")
    assert toxicity.best_threshold(np.array([0.2, 0.4]), np.array([1, 1])) == float("inf")


def test_toxicity_of_few_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, labels)
    assert got.count() == docs.count() and got.where("toxic").count() <= 0.2 * docs.count()
    one = labels.selectExpr("doc_id", "quality", "1 toxic")
    assert toxicity.judge(docs, one).where("toxic").count() == 0
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_null_and_large_ids(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(None, "a b c d e f"), (big, "a b c d e f"), (big + 1, "a b c d e f"), (None, None)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in neardup.classes(rows).collect()) == [(0, 0, 0), (0, 0, 0), (big, big, 1), (big + 1, big, 1)]
    assert sorted(r.doc_id or 0 for r in packing.pack(rows).collect()) == [0, 0, big, big + 1]
    assert neardup.keep_one(rows).count() == 3 and pii.find(rows).count() == 4 and pii.mask(rows).count() == 4
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(rows, none).count() == 4 and licenses.detect(rows).count() == 4
