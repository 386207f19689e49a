"""The redundancy analysis against a plain loop over dense matrices, on made-up measurements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.functions import statistics as stats
from partlens.operators import redundancy as R

CONFIG = R.Config(least_runs=10, drift_least=10)


@pytest.fixture(scope="module")
def measured():
    draw = np.random.default_rng(11)
    out, seq = [], 0
    for report in range(60):
        dut, dead = f"D{report % 2}", report in (7, 8)
        unit = draw.normal()
        for k in range(9):
            if draw.random() < 0.05:
                continue
            name = f"1{k % 3}A - Gain (ch-{k} band-low)" if k < 6 else f"2{k} - Loss (f-{k})"
            value = 10 + (unit + 0.1 * draw.normal() if k < 3 else draw.normal()) * 0.5
            if k in (6, 7) and report % 9 == 0 or dead and k > 2:
                value += 9
            value -= 0.05 * report if k == 8 else 0
            lower, upper = (None if k == 4 else 5.0), (None if k == 5 else 15.0)
            out.append((dut, name, f"R{report}", None if draw.random() < 0.02 else float(value), lower, upper, seq))
            seq += 1
    return out


@pytest.fixture(scope="module")
def rows(spark, measured):
    return spark.createDataFrame(measured, "dut string, test string, report string, data double, lower double, upper double, seq long").repartition(5)


def dense(measured):
    """Per dut and test: stats; per report: matrices, the way the analysis is described."""
    pairs = sorted({(d, t) for d, t, *_ in measured})
    reports = list(dict.fromkeys(r for _, _, r, *_ in measured))
    column, row = {p: i for i, p in enumerate(pairs)}, {r: i for i, r in enumerate(reports)}
    shape = (len(reports), len(pairs))
    total, n, present, failed = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    for d, t, r, x, lo, hi, _ in measured:
        at = row[r], column[d, t]
        present[at] = True
        if x is not None:
            total[at] += x
            n[at] += 1
            failed[at] |= (hi is not None and x > hi) or (lo is not None and x < lo)
    with np.errstate(invalid="ignore"):
        data = np.where(n > 0, total / n, np.nan)
    return pairs, reports, data, present, failed


def test_decisions_against_a_loop(rows, measured):
    pairs, reports, data, present, failed = dense(measured)
    share = failed.sum(1) / np.maximum(present.sum(1), 1)
    enough = present.sum(1) >= CONFIG.dead_least_tests
    dead = np.zeros(len(reports), bool)
    if enough.sum() >= 5:
        mid = np.median(share[enough])
        dead = enough & (share > max(0.3, mid + 3 * 1.4826 * np.median(abs(share[enough] - mid))))
    got = {(r.dut, r.test): r for r in R.decided(rows, CONFIG).collect()}
    assert set(got) == set(pairs)
    for i, (dut, test) in enumerate(pairs):
        own = [m for m in measured if m[:2] == (dut, test)]
        values = np.array([m[3] for m in own if m[3] is not None])
        lo, hi = own[0][4], own[0][5]
        mean, sd = values.mean(), values.std(ddof=1)
        if lo is not None and hi is not None:
            margin = np.minimum(hi - data[:, i], data[:, i] - lo) / ((hi - lo) / 2)
        else:
            margin = (hi - data[:, i] if hi is not None else data[:, i] - lo) / sd
        g = ~dead
        x, m = data[g, i][~np.isnan(data[g, i])], margin[g][~np.isnan(margin[g])]
        r = got[dut, test]
        assert (r.n_good, r.fails_good, r.fails_dead) == (present[g, i].sum(), failed[g, i].sum(), failed[dead, i].sum())
        normal = sum(0.5 * math.erfc(z / math.sqrt(2)) for z in ([] if hi is None else [(hi - mean) / sd]) + ([] if lo is None else [(mean - lo) / sd]))
        empirical = np.mean([(hi is not None and v > hi) or (lo is not None and v < lo) for v in x])
        fitted = stats.tail_probability(m)
        assert abs(r.p_tail - max(normal, empirical, 0 if math.isnan(fitted) else fitted)) < 2e-7
        drift = len(x) >= CONFIG.drift_least and stats.drifts(m)
        assert r.drift == drift
        skew = ((x - x.mean()) ** 3).mean() / x.std() ** 3
        safe = stats.hazen_quantile(m, 0.3) > 0 and not (len(x) >= 30 and abs(skew) > 1 and len(x) < math.ceil(math.log(0.05) / math.log(0.7)))
        assert r.conformal == safe and r.safe == (safe and not drift and r.p_tail < 0.05)
        assert r.reason == ("fails good units" if r.fails_good else "drift toward limit" if drift else "margin near limit" if not safe else "safe margin, no fails")
        assert r.individual == (r.fails_good == 0 and r.safe and r.parse_ok and r.n_good >= 10 and r.pooled_ub < 0.05)
    for cluster in {r.cluster for r in got.values()}:
        members = sorted((r for r in got.values() if r.cluster == cluster), key=lambda r: (r.dut, r.test))
        gate = len(members) >= 3 and np.mean([r.safe for r in members]) >= 0.4 and not sum(r.fails_good for r in members) and members[0].cohesion >= 0.3 and members[0].pooled_ub < 0.05
        assert [r.clustered for r in members] == [bool(gate and r.parse_ok and (r.safe or r.r2 >= 0.75)) for r in members]
        at = [pairs.index((r.dut, r.test)) for r in members]
        own = {x for i in at for x in [i]}
        assert len(own) == members[0].members
    assert any(r.candidate for r in got.values()) and not all(r.candidate for r in got.values())


def test_modes_cut_and_outputs(spark, rows, measured, tmp_path):
    pairs, reports, data, present, failed = dense(measured)
    found = R.analysed(rows, CONFIG, {("D0", "10"): 3.0})
    name = ["\x1f".join(p) for p in pairs]
    joint = failed.T.astype(int) @ failed.astype(int)
    there = failed.T.astype(int) @ present.astype(int)
    like = joint / np.maximum(there + there.T - joint, 1)
    near = (joint >= 2) & (like >= 0.5) & ~np.eye(len(pairs), dtype=bool)
    groups = [{name[i], *(name[j] for j in np.flatnonzero(near[i]))} for i in range(len(pairs)) if near[i].any()]
    want = sorted(sorted(g) for g in stats.distinct_modes(groups))
    got = {}
    for r in found["modes"].collect():
        got.setdefault((r.root, r.mode), []).append(r.own)
    assert sorted(sorted(g) for g in got.values()) == want and want
    cut = {"\x1f".join((r.dut, r.test)): r for r in found["tests"].collect()}
    for group in want:
        assert sum(not cut[t].removed for t in group) >= min(2, len(group))
    assert all(r.candidate for r in cut.values() if r.removed) and all(r.removed or r.kept_for_coverage for r in cut.values() if r.candidate)
    kept = [i for i, n in enumerate(name) if not cut[n].removed]
    assert found["escapes"].first().escapes == sum(failed[i].any() and not failed[i, kept].any() for i in range(len(reports)))
    assert {r.seconds for r in cut.values() if r.dut == "D0" and r.digit == "10"} == {3.0 * 60 / 2}
    R.written_out(found, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/tests", header=True).count() == len(pairs)


def test_ranges_and_tokens(spark):
    rows = [("a", "T - G (f-1 g-5)"), ("a", "T - G (f-2)"), ("a", "T - G (f-4)"), ("b", "T - G (f-3)"), ("b", "T - H (f-4 x-y)"), ("b", "plain")]
    table = spark.createDataFrame(rows, "group string, test string")
    assert sorted(map(tuple, R.ranges(table).collect())) == [("a", "f", 1.0, 2.0, 2), ("b", "f", 3.0, 4.0, 2)]
    assert {r.group: r.tokens for r in R.shared_tokens(table).collect()} == {"a": ["G", "T"]}


def test_normal_and_linked(spark):
    z = [-8.0, -2.0, -0.3, 0.0, 0.7, 3.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(R.normal_below(F.col("z"))).collect()]
    assert np.allclose(got, [stats.normal_below(x) for x in z], atol=1e-7)
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert dict(map(tuple, R.least_linked(pairs).collect())) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_profiles_are_stricter_one_by_one(rows):
    cut = [R.decided(rows, p).where("candidate").count() for p in R.PROFILES]
    assert len(cut) == 3 and cut[2] <= cut[0]
