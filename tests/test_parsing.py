"""Cases of values in texts."""

import pytest
from pyspark.sql import functions as F

from partlens.functions import parsing as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "band"),
    [("DC-18 GHz", (0, 18)), ("Up to 20 GHz", (0, 20)), ("500 MHz to 20 GHz", (0.5, 20)), ("9,000 MHz", (9, 9)), ("DC to 20000 MHz", (0, 20)), ("450", (0.45, 0.45)), ("6", (6, 6)), ("20000 GHz", None), ("none", None), ("2 - 4 GHz", (2, 4)), ("0.5 GHz ~ 900 MHz", (0.5, 0.9)), ("up to 6", (0, 6)), ("≤ 6 GHz", (0, 6)), ("2000000", (2, 2))],
)
def test_bands(spark, text, band):
    got = one(spark, P.band_ghz(F.lit(text)))
    assert (None if got is None else tuple(got)) == band


@pytest.mark.parametrize(("text", "span"), [("2 ms", (2e6, 2e6)), ("50 ns", (50, 50)), ("2", None), ("10 ns to 2 us", (10, 2000)), ("5µs max", (5000, 5000)), ("3 nsx", None), ("-5 ns", (-5, -5))])
def test_times(spark, text, span):
    got = one(spark, P.time_ns(F.lit(text)))
    assert (None if got is None else tuple(got)) == span


@pytest.mark.parametrize(("text", "layout"), [("an SPDT switch", "SPDT"), ("SP-4T", "SP4T"), ("1P6T", "SP6T"), ("DPDT", "DPDT"), ("Single Pole Four Throw", "SP4T"), ("transfer switch", "TRANSFER"), ("SP99T", ""), ("", ""), ("3P6T relay", "3P6T"), ("dual pole double throw", "DPDT"), ("1P3T", "SP3T"), ("SP4T, reflective", "SP4T"), ("sport", ""), ("five pole two throw", "")])
def test_layouts(spark, text, layout):
    assert one(spark, P.throw_layout(F.lit(text))) == layout


def test_packages(spark):
    assert tuple(one(spark, P.package(F.lit("QFN, hermetic")))) == ("surface-mount", "QFN", True)
    assert tuple(one(spark, P.package(F.lit("bare die")))) == ("die", None, None)
    for text, want in {"SOT-23 SMT": ("surface-mount", "SOT-23", None), "WR-90 flange": ("waveguide", "WR-90", None), "TO-8 can, glass-sealed": (None, "TO-8", True), "QFN-16": ("surface-mount", "QFN", None), "QFN16": (None, None, None), "Drop-in module": ("drop-in", None, None), "Connectorized-SMA": ("connectorized", "SMA", None), "": (None, None, None)}.items():
        assert tuple(one(spark, P.package(F.lit(text)))) == want, text
    assert tuple(one(spark, P.time_ns(F.lit("2 to 5"), F.lit("us")))) == (2000, 5000)
    assert one(spark, P.dedupe_commas(F.lit("Die, Die , SMA,"))) == "Die, SMA"


def test_names(spark):
    assert [one(spark, P.digit_group(F.lit(x))) for x in ("T12a - x", "T1", "abc 12")] == ["12", "1", "99"]
    kind, values = one(spark, P.spec_of(F.lit("T12 - Gain (ch-1 band-X-low ch-2)")))
    assert (kind, values) == ("Gain", {"ch": "2", "band-X": "low"})
    for text, want in {"A - B": ("B", {}), "A-B (x)": ("B", {}), "T-1-Gain at 3 (f-2.5)": ("Gain at 3", {"f": "2.5"}), " T - G (a-b) x": ("G (a-b) x", {}), "plain": ("plain", {}), "": ("(untyped)", {}), "T - (a-1)": ("(untyped)", {"a": "1"}), "T-(a-1)": ("T-(a-1)", {}), "T(1) - Gain (a-b)": ("Gain", {"a": "b"}), "T-1(a-b)": ("1", {"a": "b"}), "T- G (a-b x -y z-)": ("G", {"a": "b"})}.items():
        assert tuple(one(spark, P.spec_of(F.lit(text)))) == want, text
    assert one(spark, P.name_tokens(F.lit("b-1 a a2 3"))) == ["a", "a2", "b-1"]
    assert one(spark, P.name_tokens(F.lit("Gain_x(ch-2.5) 3db -q a2-b"))) == sorted(["Gain", "x", "ch-2.5", "db", "q", "a2", "b"])
