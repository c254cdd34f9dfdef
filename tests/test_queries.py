"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
# No SQL: one chosen sentence, and the JSON document. They are checked against the
# other queries in the other test files.
ROWS_ONLY = {"score_one", "dashboard_json"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_coverage():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ROWS_ONLY:
        assert rows
        return
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(rel.fetchall(), cols)


def test_dashboard_joins_its_opinions_once(spark, monkeypatch):
    """The sections read a stored table, and review texts are joined to narrow rows."""
    from workload import queries

    seen = []
    monkeypatch.setattr(queries.dashboard, "dashboard_sections", lambda o: seen.append(o) or o)
    QUERIES["dashboard_json"](spark, SF)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
