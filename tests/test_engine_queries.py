"""The engine's registered queries against their DuckDB SQL."""

import math

import duckdb
import pytest

from ledgerframe import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cells(rows, order):
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    out = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = cells(out.fetchall(), [names.index(c) for c in sorted(names)])
    got = cells([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(names)])
    assert got == want
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
