"""Cases for the columns: units, intervals, filters, keys."""

import pytest
from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import text as X
from partlens.operators import resolve as R
from partlens.operators import store as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "bounds"), [("40", (40, None)), (">30", (30, None)), ("<2", (None, 2)), ("=5", (5, 5)), ("4-8", (4, 8)), ("8-4", (4, 8)), ("4-", (4, None)), ("-8", (-8, None)), ("abc", None)])
def test_filter_language(text, bounds):
    assert N.parse_filter(text) == bounds


def test_units(spark):
    assert one(spark, N.to_ghz(F.lit(450.0), F.lit("MHz"))) == 0.45
    assert one(spark, N.to_ghz(F.lit(450.0), F.lit("parsec"))) is None
    assert one(spark, N.inferred_ghz(F.lit(450.0))) == 0.45
    assert one(spark, N.watts_to_dbm(F.lit(1.0))) == 30.0


def test_wilson_without_trials(spark):
    assert one(spark, N.wilson_upper(F.lit(0), F.lit(0))) == 1.0
    assert abs(one(spark, N.wilson(F.lit(5), F.lit(10))[0]) - 0.236593) < 1e-5


def test_margin_and_cpk_with_one_limit(spark):
    none = F.lit(None).cast("double")
    assert one(spark, N.cpk(F.lit(1.0), F.lit(0.5), none, F.lit(4.0))) == 2.0
    assert one(spark, N.margin(F.lit(1.0), none, F.lit(4.0), F.lit(0.0))) == 3.0


def test_keys(spark):
    assert one(spark, X.loose_keep_plus(F.lit("ab-1+ c"))) == "AB1+C"
    assert one(spark, X.loose(F.lit("ab-1+ c"))) == "AB1C"
    assert one(spark, X.family_key(F.lit("hmc 1-SP"))) == "HMC1"
    assert one(spark, X.vendor_matches(F.lit("Acme Corp."), F.lit("acme"))) is True
    assert one(spark, X.vendor_matches(F.lit("Acme"), F.lit("!"))) is False


def test_half_even_and_unknown(spark):
    met, missed, unknown = R.criteria({"a": F.lit(True), "b": F.lit(None).cast("boolean")})
    row = spark.range(1).select(met, missed, unknown, R.fit(met, unknown, 2), R.tier(missed, unknown)).first()
    assert tuple(row) == (1, 0, 1, 68, "B")


def test_merge_is_idempotent_and_order_free(spark):
    rows = [(1, "a", 1), (1, "", 2), (1, "b", 3), (2, "", 1)]
    for data in (rows, rows[::-1], rows + rows):
        got = S.upsert_text(spark.createDataFrame(data, "k long, v string, seq long"), ["k"], ["v"], "seq").collect()
        assert sorted(map(tuple, got)) == [(1, "b"), (2, "")]


def test_one_sided_band_is_no_band(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 9.0)], "k long, v double")
    assert sorted(map(tuple, R.fold_band(rows, ["k"], F.col("v")).collect())) == [(1, None, None), (2, 1.0, 9.0)]
