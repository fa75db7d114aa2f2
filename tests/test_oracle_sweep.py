"""Every query with an SQL form against its DuckDB oracle, at sf0.001."""

import os

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from coffer.registry import QUERIES
from oracle_sql import ORACLE
from tools.check_oracle import digest

SLOW = {"stream_team_totals", "stream_redeem"}
# the library's own queries: those of optional subpackages are tested beside them
NAMES = sorted(k for k in ORACLE if k in QUERIES and k not in SLOW)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "donation_score" in df.columns
