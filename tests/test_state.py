"""Frontier, logs, memories, merges and parts of texts on small tables."""

import pytest
from pyspark.sql import functions as F

from partlens.functions import display as D
from partlens.functions import requirement as Q
from partlens.functions import sections as T
from partlens.functions import vocabulary as V
from partlens.operators import health as H
from partlens.operators import lookup as U
from partlens.operators import mining as G
from partlens.operators import store as S
from partlens.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture
def frontier(spark):
    rows = [("http://a.com/Mixer", 5.0, "pending", "a.com", None), ("http://a.com/amp", 9.0, "pending", "a.com", None), ("http://b.com/x", 7.0, "pending", "b.com", None), ("http://c.com/done", 9.0, "done", "c.com", 1.0)]
    return spark.createDataFrame(rows, "url string, priority double, status string, domain string, fetched_at double")


def test_frontier(spark, frontier):
    level = lambda df: {r.url: r.priority for r in df.collect()}
    assert level(state.boosted(frontier, ["MIXER", "done"], 3, 7)) == {"http://a.com/Mixer": 7, "http://a.com/amp": 9, "http://b.com/x": 7, "http://c.com/done": 9}
    assert level(state.floored(frontier, 8, domain="b.com"))["http://b.com/x"] == 8 and level(state.floored(frontier, 10, part="amp"))["http://a.com/amp"] == 10
    done = spark.createDataFrame([("http://b.com/x", "failed", 2.0), ("http://b.com/x", "done", 3.0)], "url string, status string, at double")
    assert [(r.status, r.fetched_at) for r in state.marked(frontier, done).where("url LIKE '%b.com%'").collect()] == [("done", 3.0)]
    assert [r.url for r in state.popped(frontier, {"a.com": 1}, avoid=["a.com"]).collect()] == ["http://b.com/x", "http://a.com/amp"]
    assert [r.url for r in state.popped(frontier, {"a.com": 2, "b.com": 0}, skip=["AMP"]).collect()] == ["http://a.com/Mixer"]


def test_logs_and_memories(spark):
    log = spark.createDataFrame([("q", "k" * 450, "page", "ok", "d" * 300, 1.0), ("q", "k2", "page", "failed", "", 1.0)], "vendor string, key string, kind string, status string, detail string, updated_at double")
    new = spark.createDataFrame([("q", "k2", "page", "ok", "", 2.0)], log.schema)
    both = state.logged(log, new)
    assert sorted((len(r.key), r.status, len(r.detail)) for r in both.collect()) == [(2, "ok", 0), (400, "ok", 200)]
    work = spark.createDataFrame([("q", "k" * 450), ("q", "k2"), ("q", "k3")], "vendor string, key string")
    assert [r.key for r in state.remaining(work, log).orderBy("key").collect()] == ["k2", "k3"] and [r.key for r in state.remaining(work, log, ok_only=False).collect()] == ["k3"]
    assert state.cleared(log, ["Q"]).count() == 0 and state.cleared(log, ["z"]).count() == 2
    documents, seen = spark.createDataFrame([("a",), ("b",)], "sha256 string"), spark.createDataFrame([("a", 3), ("b", 1)], "sha256 string, parser_version int")
    assert [r.sha256 for r in state.unseen(documents, seen, 2).collect()] == ["b"]
    files, known = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, fingerprint string"), spark.createDataFrame([("p", "1", 2), ("q", "1", 2)], "path string, fingerprint string, parser_version int")
    assert [r.path for r in state.changed(files, known, 2).collect()] == ["q"] and state.changed(files, known, 3).count() == 2
    memory = spark.createDataFrame([("m", "u", "404", 1.0), ("m", "v", "timeout", 1.0)], "mpn string, url string, status string, at double")
    kept, left = state.remembered(memory, memory.limit(0), memory.select("mpn", "url"), ["404"])
    assert kept.count() == 2 and [r.url for r in left.collect()] == ["v"]
    assert one(spark, state.fingerprint(F.lit(b"abc"))) == "3:a9993e364706816a"
    assert one(spark, state.page_signature(F.lit("x" * 9000))) != one(spark, state.page_signature(F.lit("x" * 9001)))
    parts = spark.createDataFrame([("A", "x1", 1), ("a", "X1", 2)], "vendor string, mpn string, seq int")
    assert [r.seq for r in state.live(parts).collect()] == [2]


def test_merges(spark):
    both = S.merged_facts(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, both) == {"a": "1", "b": "3"}
    base, over = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], "name string, n int, s string"), spark.createDataFrame([("y", 5), ("z", 6)], "name string, n int")
    assert sorted(map(tuple, S.overlaid(base, over, "name").collect())) == [("x", 1, "p"), ("y", 5, "q"), ("z", 6, None)]
    a, b = spark.createDataFrame([("Acme Inc",)], "vendor string"), spark.createDataFrame([("acme-inc",), ("Zeta",), (" ",)], "vendor string")
    assert [r.vendor for r in S.vendor_names(a, b).collect()] == ["Acme Inc", "Zeta"]
    links = spark.createDataFrame([("v", "k", 1, "u1", "space_grade"), ("v", "k", 2, "u2", None)], "vendor string, key string, seq int, url string, space string")
    more = spark.createDataFrame([("v", "k", 1, "u0", "space_qualified"), ("v", "k", 2, "u1", None)], links.schema)
    row = S.link_lists([more, links], ["vendor", "key"]).first()
    assert row.urls == ["u0", "u1", "u2"] and row.space == 2
    parts, children = spark.createDataFrame([(1, "Acme Corp"), (2, "Zeta")], "part_id int, vendor string"), {"specs": spark.createDataFrame([(1, "k"), (2, "k")], "part_id int, key string")}
    kept, own = S.reset(parts, children, ["acme"])
    assert [r.part_id for r in kept.collect()] == [2] and [r.part_id for r in own["specs"].collect()] == [2] and S.reset(parts, children)[0].count() == 0
    rows = spark.createDataFrame([(i, i % 3) for i in range(60)], "id int, cell int")
    assert {r.cell: r["count"] for r in S.sampled(rows, ["cell"], "id", 4).groupBy("cell").count().collect()} == {0: 4, 1: 4, 2: 4}
    assert sorted(map(tuple, S.sampled(rows, ["cell"], "id", 4).collect())) == sorted(map(tuple, S.sampled(rows.repartition(7), ["cell"], "id", 4).collect()))
    hits = spark.createDataFrame([("d", 2, "p", 1, 1.0), ("d", 2, "p", 2, 2.0)], "domain string, n_segments int, prefix string, hits long, updated_at double")
    assert S.counted_templates(hits).first().hits == 3


def test_sections_and_labels(spark):
    text = "TITLE LINE\nGeneral Description\nA wide amplifier.\nMore of it.\nFEATURES\n• Low noise\n\nELECTRICAL SPECIFICATIONS\nGain 3 dB"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    assert {r.section: r.text for r in T.sections(rows, "id").collect()} == {"description": "A wide amplifier.\nMore of it.", "features": "• Low noise"}
    notes = "Screened to MIL-STD-883\nscreened to mil std 883\n38534 1 2 3 4 class 5 6 7 8\nplain words\nHermetic package"
    assert one(spark, T.qualification_notes(F.lit(notes))) == "Screened to MIL-STD-883\nHermetic package"
    assert one(spark, T.qualification_notes(F.lit(notes), 25)) == "Screened to MIL-STD-883"
    for raw, want in {"1. Insertion Loss (typ), dB": "insertion loss", "Noise Figure max dB": "noise figure", "This is the prose of it.": None, "12 34 56": None, "LO-RF Isolation": "lo-rf isolation", "": None}.items():
        assert one(spark, T.clean_label(F.lit(raw))) == want, raw
    assert one(spark, T.ports_in(F.lit("LO to RF isolation"))) == ["rf", "lo"]
    assert tuple(one(spark, T.without_bullet(F.lit("• Low noise")))) == ("Low noise", True) and tuple(one(spark, T.without_bullet(F.lit("Gain")))) == ("Gain", False)
    for path, want in {"/a/HMC8038_datasheet_revA.pdf": "HMC8038", "x/Data Sheet ADM-8344PC (1).pdf": "ADM-8344PC", "notes.txt": "notes"}.items():
        assert one(spark, T.number_of_file(F.lit(path))) == want
    assert one(spark, T.redacted(F.lit("The ZX60-V82-S+ and zx60 v82 s, not ZX601V82S"), F.lit("ZX60-V82-S+"))) == "The [PN] and [PN], not ZX601V82S"
    assert one(spark, T.composed(F.lit(" T "), F.lit(""), [F.lit("d")])) == "T\nd"
    assert [one(spark, T.url_problem(F.lit(u))) for u in ("http://a.b/c", "", "ftp://x.y", "http://nohost", "http://a.b/{pn}")] == [None, "empty", "no scheme", "no host", "unfilled template"]
    assert one(spark, T.url_candidates(F.lit("http://s.t/1"), F.lit("Ab-1-TR"), ["http://h.i/{pn_lower}", "http://h.i/{pn_base}", "http://s.t/1"])) == ["http://s.t/1", "http://h.i/ab-1-tr", "http://h.i/Ab-1"]


def test_requirements():
    asked = Q.built(category="LNA", freq="DC-18", impedance_ohm="50 ohm", ports="x", connector="2.92 mm", package="Surface Mount", nf_db_max=2.0, space=True)
    assert (asked.category, asked.freq_ghz, asked.impedance_ohm, asked.ports, asked.connector, asked.package, asked.specs) == ("amplifier", (0.0, 18.0), 50.0, None, "2.92MM", "smt", {"nf_db_max": 2.0})
    assert Q.band("18 to 2") == (2.0, 18.0) and Q.band("") is None and Q.impedance(None) is None
    low = Q.by_response(Q.built(freq="1-6"), "lowpass")
    assert (low.freq_ghz, low.cutoff_ghz) == (None, 6.0) and Q.by_response(Q.built(freq="1-6"), "highpass", 2.0).cutoff_ghz == 2.0 and Q.by_response(Q.built(freq="1-6"), "bandstop").stopband_ghz == (1.0, 6.0)
    assert [Q.space_word(w) for w in ("Qualified", "grade", "any", "none", None)] == ["space_qualified", "space_grade", "any-space", "none", None]
    assert V.category_of("Splitter") == "divider" and V.category_of("odd") == "odd" and V.package_of("qfn") == "smt" and V.synonyms("zz") == ["zz"]
    assert "lna" not in V.excluded_by("amplifier", "hpa") and "low noise amplifier" in V.excluded_by("amplifier", "hpa") and V.excluded_by("nothing", "x") == []
    assert V.fields("coupler")[:3] == ["freq", "ports", "coupling_db"] and V.fields("coupler")[-1] == "max_lead_weeks" and H.coverage_keys("limiter") == ["freq_ghz", "package", "power_w"]


def test_display(spark):
    for key, want in {"noise_nf_db": "Noise NF (dB)", "vswr": "VSWR", "tid_krad": "TID (kRad)", "switching_time_ns": "Switching Time (ns)"}.items():
        assert one(spark, D.label(F.lit(key))) == want
    shown = {0.5: "0.5", 12.0: "12", 1234567.0: "1234567", 0.0: "0", -3.25: "-3.25"}
    assert {k: one(spark, D.short(F.lit(k))) for k in shown} == shown
    assert one(spark, D.band(F.lit(None).cast("double"), F.lit(6.0))) == "≤6" and one(spark, D.lead(F.lit(0.0))) == "in stock" and one(spark, D.price(F.lit(None).cast("double"))) == "RFQ"
    assert one(spark, D.criteria(F.create_map(F.lit("gain"), F.lit("met"), F.lit("freq"), F.lit("unknown")))) == "freq? gain✓"
    assert one(spark, D.ranges(F.array(F.struct(F.lit("f").alias("key"), F.lit(1.0).alias("lo"), F.lit(2.5).alias("hi"), F.lit(3).alias("n"))))) == "f 1..2.5 (3 vals)"
    assert one(spark, D.cell_state(F.lit("met"), F.lit(True))) == "met" and one(spark, D.cell_state(F.lit(None).cast("string"), F.lit(False))) == "na"
    assert one(spark, D.subtype(F.lit(""), F.lit("non_reflective type of a switch"))) == "non reflective type of " [:22]


def test_lookups(spark):
    asked = spark.createDataFrame([(0.5,), (5.0,), (22.0,), (50.0,)], "f double")
    bands = spark.createDataFrame([(1.0, 10.0, 1.0), (25.0, 40.0, 2.0)], "lo double, hi double, v double")
    assert [r.v for r in U.piecewise(asked, bands, "f", "v").orderBy("f").collect()] == [1.0, 1.0, 2.0, 2.0]
    assert [r.v for r in U.piecewise(asked, bands, "f", "v", few=1).orderBy("f").collect()] == [1.0, 1.0, 2.0, 2.0]
    samples = spark.createDataFrame([("k", 1.0, 10.0), ("k", 3.0, 30.0)], "key string, f double, v double")
    own = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.0), ("k", 9.0), ("z", 2.0)], "key string, f double")
    assert [r.v for r in U.interpolated(own, samples, ["key"], "f", ["v"]).orderBy("key", "f").collect()] == [10, 20, 30, None, None]
    assert [r.v for r in U.interpolated(own, samples, ["key"], "f", ["v"], "hold").orderBy("key", "f").collect()] == [10, 20, 30, 30, None]


def test_enriched_from_a_cache(spark):
    parts, library = spark.createDataFrame([(1, "AB-1"), (2, "CD-2")], "part_id int, mpn string"), spark.createDataFrame([("AB1", "/d/ab1.txt", "i1"), ("CD2", "/d/cd2.txt", "i2")], "key string, path string, identity string")
    texts = spark.createDataFrame([("/d/ab1.txt", "Noise figure 2.5 dB, RF frequency range 2-6 GHz"), ("/d/cd2.txt", "Gain 9 dB")], "path string, text string")
    rows, cache = G.enriched(parts, library, texts)
    got = {(r.part_id, r.key): r.value_typ for r in rows.collect()}
    assert got == {(1, "nf_db"): 2.5, (1, "freq_min"): 2.0, (1, "freq_max"): 6.0, (2, "gain_db"): 9.0}
    again, _ = G.enriched(parts, library, texts.withColumn("text", F.lit("Gain 1 dB")), cache)
    assert {(r.part_id, r.key): r.value_typ for r in again.collect()} == got
    changed, _ = G.enriched(parts, library.withColumn("identity", F.lit("new")), texts.withColumn("text", F.lit("Gain 1 dB")), cache)
    assert {r.value_typ for r in changed.collect()} == {1.0}
    stored = spark.createDataFrame([(1, "nf_db", 4.0), (2, "gain_db", 9.5)], "part_id int, key string, value double")
    assert [(r.part_id, r.key) for r in G.conflicts(rows.select("part_id", "key", F.col("value_typ").alias("value")), stored).collect()] == [(1, "nf_db")]
