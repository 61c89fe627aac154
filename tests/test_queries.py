"""Registered queries against their SQL twins on the smallest tables, and the same rows under other partitionings."""

from __future__ import annotations

import glob
import math

import pytest

from quire.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted([tuple(plain(x) for x in r) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {f.split('/')[-1][:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted({*registry.queries()} - {*registry.oracle_sql()}))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["styled_spans", "first_code_wins", "lru_memory", "page_layout", "payload_offsets"])
def test_any_number_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(registry.queries()[name](spark, FOLDER).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert not math.isnan(len(found[0]))
