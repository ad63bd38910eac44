"""Every query of the catalogue against its DuckDB SQL."""

import decimal

import pytest

from sedge.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    want = duck.sql(ORACLE[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(df.columns) == sorted(want.columns)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_exclude_reads_every_customer(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    got = sorted((r.c_custkey, r.n) for r in QUERIES["window_exclude"](spark, folder).collect())
    assert len(got) == con.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert got == sorted(con.sql(ORACLE["window_exclude"]).fetchall())
