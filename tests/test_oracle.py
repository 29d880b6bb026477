"""Every registered query against its DuckDB twin on the smallest scale."""


import duckdb
import pytest

from conftest import SF_SMALL
from __spark_entry__ import entry, oracle_sql, queries
from plaudit.sources.standins import TABLES
from tools.oracle_check import digest

ORACLES = oracle_sql()
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(NAMES)


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["appid", "base_score", "score", "score_class", "suggestion"]


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = digest(sdf.columns, srows)
    hd, ld = digest(dcols, drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ORACLES])
def test_rows_only(spark, name):
    assert queries()[name](spark, SF_SMALL).count() > 0
