"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sievekit.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(duck.sql(core.ORACLES[name]).columns) == columns
    expected = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({core.ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(columns).collect())) == plain(expected)


def test_every_query_is_named_once():
    assert set(core.ORACLES) <= set(core.QUERIES)
