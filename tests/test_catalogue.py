"""Every registered query against its SQL on the smallest dataset."""

import os

import duckdb
import pandas as pd
import pytest

from partlens.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    def plain(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no dataset")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, oracle, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), oracle.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_cusum_against_a_loop(spark, small):
    got = {(r.dut, r.test): r.cusum for r in catalogue.QUERIES["cusum_drift"](spark, small).collect()}
    frame = spark.read.parquet(f"{small}/lineitem.parquet").toPandas().sort_values(["l_orderkey", "l_linenumber", "l_quantity"])
    for (dut, test), own in frame.groupby(["l_returnflag", "l_suppkey"]):
        x = own["l_quantity"]
        s = low = 0.0
        for z in (x - x.mean()) / x.std(ddof=1):
            s = min(0.0, s + z + 0.5)
            low = min(low, s)
        assert abs(got[(dut, test)] - low) < 1e-5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
