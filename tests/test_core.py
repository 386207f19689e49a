"""Statistics, clusters, network formulas, sources and state on small inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from partlens.functions import network as net
from partlens.functions import statistics as stats
from partlens.operators import clusters
from partlens.sources import readers, writers
from partlens.streaming import state


def test_beta_quantile():
    assert abs(stats.beta_quantile(0.95, 1, 10) - (1 - 0.05 ** (1 / 10))) < 1e-9
    assert abs(stats.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6


def test_hazen_and_tail():
    assert stats.hazen_quantile(np.array([1.0, 2, 3, 4]), 0.25) == 1.5
    assert np.isnan(stats.tail_probability(np.ones(10)))
    m = np.random.default_rng(0).normal(2, 1, 5000)
    assert 0.005 < stats.tail_probability(m) < 0.06


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]])
    assert stats.average_linkage(d, 0.6) == [0, 0, 1]
    assert stats.average_linkage(np.array([[0, 0.6], [0.6, 0]]), 0.6) == [0, 0]


def test_greedy_cut_and_modes():
    assert stats.distinct_modes([{1, 2, 3, 4}, {1, 2, 3}, {8, 9}]) == [{1, 2, 3, 4}, {8, 9}]
    removed, kept = stats.greedy_cut([[1, 2, 3], [3, 4]], {1, 2, 3}, {1: 5.0, 2: 1.0, 3: 9.0, 4: None})
    assert (removed, kept) == ({1}, {2, 3}) or (removed, kept) == (set(), {1, 2, 3})
    assert stats.greedy_cut([[1, 2, 3, 9]], {1, 2, 3}, {}) == ({2, 3}, {1})  # 9 stays anyway


def test_correlation_and_r2():
    x = np.random.default_rng(1).normal(size=(50, 1))
    both = np.column_stack([x, 2 * x, -x])
    assert abs(stats.mean_abs_correlation(both) - 1) < 1e-9 and stats.predict_r2(both, 0) > 0.999
    assert stats.mean_abs_correlation(both[:, :1]) == 1 and stats.mean_abs_correlation(both[:2]) == 1
    noise = np.random.default_rng(2).normal(size=(40, 3))
    want = np.abs(np.corrcoef(noise, rowvar=False))[np.triu_indices(3, 1)].mean()
    assert abs(stats.mean_abs_correlation(np.column_stack([noise, np.ones(40)])) - want) < 1e-12
    assert stats.predict_r2(both[:9], 0) == 0 and stats.predict_r2(np.column_stack([x, np.ones(50)]), 0) == 0
    assert stats.predict_r2(np.column_stack([np.ones(50), x]), 0) == 0


def test_drift_against_a_loop():
    draw = np.random.default_rng(3)
    for n in (4, 5, 30, 200):
        for trend in (0.0, -0.02, 0.02, -0.2):
            m = draw.normal(size=n) + trend * np.arange(n)
            want = False
            if n >= 5:
                s, low = 0.0, False
                for z in (m - m.mean()) / m.std(ddof=1):
                    s = min(0.0, s + z + 0.5)
                    low |= -s > 5
                line = np.polyfit(np.arange(1, n + 1), m, 1)
                want = low or (line[0] < 0 and np.polyval(line, n + 0.5 * (n - 1)) < stats.hazen_quantile(m, 0.01))
            assert stats.drifts(m) == want
    assert not stats.drifts(np.ones(50))


def test_pooled_bounds():
    none = stats.pooled_bounds(np.zeros(3), np.array([100, 100, 0]), np.zeros((100, 3)))
    assert np.allclose(none, stats.beta_quantile(0.95, 0.5, 200.5))
    k, n = np.array([0, 1, 20, 0, 40]), np.full(5, 100)
    rates = k / n
    weight = rates.mean() * (1 - rates.mean()) / rates.var(ddof=1) - 1
    assert np.isclose(stats.pooled_bounds(k, n, np.zeros((100, 5)))[2], stats.beta_quantile(0.95, rates.mean() * weight + 20, (1 - rates.mean()) * weight + 80))
    same = np.zeros((100, 2))
    same[:3] = 1  # always fail together: the runs count once
    assert np.isclose(stats.pooled_bounds(np.array([0, 3]), np.array([100, 100]), same)[0], stats.beta_quantile(0.95, 0.5, 200 / 2 + 0.5))
    assert np.isnan(stats.pooled_bounds(np.zeros(2), np.zeros(2), np.zeros((0, 2)))).all()


def test_tail_at_the_limit():
    m = np.concatenate([np.full(40, -1.0) - np.arange(40), np.ones(160)])
    assert stats.tail_probability(m) == (m < stats.hazen_quantile(m, 0.1)).mean()


def test_cascade_of_lines_adds_loss():
    f = net.grid(1, 10, 1)
    a = net.line(f, 0.1 * f, 1e-9)
    both = net.cascade(a, a)
    assert np.allclose(20 * np.log10(abs(both[:, 1, 0])), -0.2 * f) and np.allclose(both[:, 0, 1], both[:, 1, 0])
    j = net.junction(np.full(len(f), 0.2))
    assert np.allclose(abs(j[:, 0, 0]) ** 2 + abs(j[:, 1, 0]) ** 2, 1)


def test_grid_has_exact_ends():
    g = net.grid(0, 10, 1, 2, 4)
    assert g.tolist() == [0, 1, 2, 3, 4, 6, 8, 10]


def test_l_match_residual():
    for source, wanted in ((50 + 0j, 20 - 30j), (20 - 30j, 50 + 0j), (10 + 5j, 12 + 40j)):
        found = net.l_match(source, wanted)
        assert found and all(r < 1e-9 for *_, r in found)
        for form, x, b, _ in found:  # element by element
            seen = 1 / (1 / source + 1j * b) + 1j * x if form == "shunt-series" else 1 / (1 / (source + 1j * x) + 1j * b)
            assert abs(seen - wanted) < 1e-9


def test_touchstone_round_trip(spark, tmp_path):
    f = net.grid(1, 3, 1)
    s = net.line(f, 0.5 * f, 1e-10)
    (tmp_path / "a.s2p").write_text("! note\n" + net.write_touchstone(f, s) + "1 0.5 0.3 45 0.2\n")
    samples, noise, z0 = net.read_touchstone((tmp_path / "a.s2p").read_text())
    assert z0 == 50 and len(noise) == 1 and np.allclose([x[2] for x in samples], s[:, 1, 0])
    assert readers.touchstone(spark, str(tmp_path / "a.s2p")).count() == 3


def test_clusters(spark):
    rows = [("1", "a", ["x", "y"]), ("1", "b", ["x", "y"]), ("1", "c", ["q"]), ("2", "d", [])]
    got = {r.test: r.cluster for r in clusters.token_clusters(spark.createDataFrame(rows, "block string, test string, tokens array<string>")).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0}
    bare = spark.createDataFrame([("1", "a", []), ("1", "b", []), ("2", "a", []), ("2", "b", []), ("2", "c", ["x"])], "block string, test string, tokens array<string>")
    assert sorted((r.block, r.cluster) for r in clusters.token_clusters(bare).collect()) == [("1", 0), ("1", 0), ("2", 0), ("2", 1), ("2", 2)]


def test_cycle_reports(spark):
    rows = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "a", 3), ("u", "a", 4)], "dut string, test string, seq long")
    assert [r.report_no for r in clusters.cycle_reports(rows).orderBy("seq").collect()] == [1, 1, 2, 3]


def test_measurement_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dut_name,Part Number,measurement_name,data,units,upper_limit,lower_limit,test_report_id\nd,p,t,1.5,V,2,Inf,r\n ,p,t,1,V,2,0,r\nd,p,t,bad,V,2,0,r\n")
    got = readers.measurements(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.data, r.lower) for r in got] == [(1.5, None), (None, 0.0)]
    (tmp_path / "b.csv").write_text("Test Result Name,Legacy ID,Data,DUT Name,Units,Upper Limit,Lower Limit,Result Stop Date/Time\nt,p,1,d,V,2,0,2020-01-02 03:04:05\n")
    assert readers.measurements(spark, str(tmp_path / "b.csv")).first().ts.hour == 3


def test_catalogue_and_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"parts": [{"part_number": "A1"}, {"part_number": None}]}))
    assert [r.pn for r in readers.catalogue(spark, str(tmp_path / "c.json")).collect()] == ["A1"]
    page = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td><b>1</b> x</td></tr></table><table><tr><td>z</td></tr></table>")], "id long, html string")
    assert [(r.row_ix, r.text) for r in readers.html_tables(page, "id").orderBy("row_ix").collect()] == [(0, "A"), (1, "1 x")]


def test_file_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.4"),), (bytearray(b"<!DOCTYPE html>"),), (bytearray(b"PK\x03\x04"),), (bytearray(b"plain"),), (bytearray("�".encode() * 50),), (bytearray("�".encode() + b"x" * 200),), (bytearray("�".encode() * 3 + b"x" * 400),), (bytearray(b"\xfe\xfb\xfb\xfd" * 40),)], "content binary")
    assert [r[0] for r in rows.select(readers.file_kind(F.col("content"))).collect()] == ["pdf", "html", "zip", "text", "corrupt", "text", "corrupt", "text"]


def test_markdown(spark):
    rows = spark.createDataFrame([(1, "A", 94, 3, 0)], "part_id long, tier string, fit int, met int, unknown int")
    assert "## A" in writers.markdown(rows) and "## B" not in writers.markdown(rows)


def test_frontier_push(spark):
    old = spark.createDataFrame([("a", 5, "pending", 1), ("b", 5, "done", 2)], "url string, priority int, status string, seq long")
    new = spark.createDataFrame([("a", 9, 3), ("b", 9, 4), ("c", 1, 5)], "url string, priority int, seq long")
    assert sorted(tuple(r)[:3] for r in state.push(old, new).collect()) == [("a", 9, "pending"), ("b", 5, "done"), ("c", 1, "pending")]
    assert sorted(tuple(r)[:3] for r in state.push(old, new, requeue=True).collect())[1] == ("b", 9, "pending")


def test_stream_replay_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = state.windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="3650 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("replayed").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows)
    assert key(spark.table("replayed").collect()) == key(state.windows(events).collect())


def test_bands_and_tables():
    f = np.array([0.5, 1.0, 10.0, 15.0, 22.0, 30.0, 50.0])
    bands = [(20.0, 40.0, 1.9), (1.0, 10.0, 1.1), (10.0, 20.0, 1.3)]
    assert net.in_bands(bands, f).tolist() == [1.1, 1.1, 1.1, 1.3, 1.9, 1.9, 1.9]
    assert np.isclose(net.in_bands(bands, np.array([50.0]), "linear")[0], 1.9 + 0.6 / 15 * 20)
    assert net.in_bands([], f).tolist() == [1.0] * 7
    with np.testing.assert_raises(ValueError):
        net.in_bands(bands, f, "error")
    assert net.points([(2, 4), (1, 2)])(np.array([0.5, 1.5, 9])).tolist() == [2, 3, 4] and net.const(3)(f).tolist() == [3] * 7
    assert net.interpolated(np.array([2.0, 1.0]), np.array([2j, 1 + 0j]), 1.5) == 0.5 + 1j
    with np.testing.assert_raises(ValueError):
        net.interpolated(np.array([2.0, 1.0]), np.array([2j, 1j]), 3)


def test_cable_models():
    f = net.grid(1, 18, 0.5)
    spec = net.Cable(*net.JUMPER, vswr=((0.0, 6.0, 1.2), (6.0, 18.0, 1.4)), stability_ppm=100.0)
    for kind in ("none", "flat", "ripple"):
        s = net.cable(spec, f, 3.0, kind)
        assert np.allclose(s[:, 0, 1], s[:, 1, 0]) and (np.abs(s[:, 0, 0]) ** 2 + np.abs(s[:, 1, 0]) ** 2 <= 1 + 1e-12).all()
    assert np.allclose(-20 * np.log10(np.abs(net.cable(spec, f, 3.0, "none")[:, 1, 0])), spec.loss_db(f, 3.0))
    assert np.allclose(np.abs(net.cable(spec, f, 3.0, "flat")[:, 0, 0]), np.where(f <= 6, 0.2 / 2.2, 0.4 / 2.4))
    assert (np.abs(net.cable(spec, f, 3.0)[:, 0, 0]) <= 0.4 / 2.4 + 1e-3).all()
    assert np.isclose(spec.delay_s(1.0, 1.0) / spec.delay_s(1.0), 1.0001) and np.isclose(net.Cable(delay_ns_per_foot=1.5).delay_s(2), 3e-9)


def test_device_matrix():
    f = net.grid(1, 2, 1)
    spec = net.Device(3, (net.Path(1, 2, net.poly(-1.0, -0.5), 0.1), net.Path(2, 3, net.const(12), reciprocal=False, reverse_db=30)), isolation_db=40, vswr={2: ((0.0, 9.0, 3.0),)})
    s = net.device(spec, f)
    assert np.allclose(20 * np.log10(np.abs(s[:, 1, 0])), [-1.5, -2]) and np.allclose(s[:, 1, 0], s[:, 0, 1])
    assert np.allclose(np.abs(s[:, 2, 1]), 10 ** (12 / 20)) and np.allclose(np.abs(s[:, 1, 2]), 10 ** (-30 / 20)) and np.allclose(np.abs(s[:, 2, 0]), 0.01)
    assert np.allclose(s[:, 1, 1], 0.5) and np.allclose(s[:, 0, 0], 0)
    assert net.between_ports(s, [3, 1]).shape == (2, 2, 2) and np.allclose(net.between_ports(s, [3, 1])[:, 0, 1], s[:, 2, 0])
    assert np.allclose(net.noise_db(spec, f, s), [1.5, 2]) and net.noise_db(net.Device(2, noise_db=net.const(3)), f, s).tolist() == [3, 3]
    assert np.isclose(np.angle(s[0, 1, 0]), -2 * np.pi * 0.1)


def test_parts_and_targets():
    w = 2 * np.pi * 1e9
    assert net.series_part(10, w) == ("L", 10 / w) and net.series_part(-10, w) == ("C", 1 / (w * 10)) and net.series_part(0, w)[0] == "none"
    assert net.shunt_part(0.1, w) == ("C", 0.1 / w) and net.shunt_part(-0.1, w) == ("L", 1 / (w * 0.1))
    noise = [(1.0, 0.5, 0.2 + 0j, 0.1), (2.0, 0.6, 0.4 + 0j, 0.1)]
    assert net.wanted_impedance(50, 1.5, 20 + 1j, 0.5) == 20 + 1j and net.wanted_impedance(50, 1.5, None, 0.5) == 150
    assert np.isclose(net.wanted_impedance(50, 1.5, noise=noise), 50 * 1.3 / 0.7) and net.wanted_impedance(50, 1, to_z0=True) == 50
    with np.testing.assert_raises(ValueError):
        net.wanted_impedance(50, 1)
    assert net.design_frequency(noise, []) == 1.5 and net.design_frequency([], [(4.0,), (6.0,)]) == 5 and net.design_frequency(noise, [], 9) == 9
    assert net.impedance(0.0) == 50 and net.impedance(1 / 3) == 100.00000000000001 or np.isclose(net.impedance(1 / 3), 100)
