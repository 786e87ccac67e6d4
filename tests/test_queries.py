"""Every query against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from beaconq.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else None if x is None or x != x else x for x in row)


def compared(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    wanted = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    got = query(spark, sf)
    assert sorted(got.columns) == columns
    found = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    return found, wanted


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found, wanted = compared(spark, name, QUERIES[name], ORACLES[name])
    assert len(found) == len(wanted)
    assert [r for r in found if r not in set(wanted)][:3] == []
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
