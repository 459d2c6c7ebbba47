"""Every query against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in e.oracle_sql() if n in e.registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (decimal.Decimal, int)):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = e.queries()[name](spark, SF)
    cur = duck.execute(e.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    expected = rows(names, cur.fetchall())
    assert rows(got.columns, got.collect()) == expected
    assert expected or name in {"v6_ledger_residuals"}


def test_entry_and_shares(spark):
    assert e.entry(spark).count() == 1200
    n = {r.endpoint: r.n for r in e.queries()["s18_weighted_pick"](spark, SF).collect()}
    assert all(abs(n[i] / sum(n.values()) - (i + 1) / 6) < 0.05 for i in range(3))


def test_all_columns_named(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
