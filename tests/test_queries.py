"""Registered queries against their SQL on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_queries  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from dayloom.plans.catalog import QUERIES  # noqa: E402

SQL = oracle_sql()
# TEST_QUERIES names a few for a quick run; all queries of the diary study are checked otherwise.
NAMES = os.environ.get("TEST_QUERIES", "all").split()
NAMES = sorted(set(SQL) & set(QUERIES)) if NAMES == ["all"] else NAMES


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_queries.duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    got = check_queries.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    assert got == check_queries.rows([d[0] for d in cur.description], cur.fetchall())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(queries())


def test_sixty_routines(spark, sf_dir):
    days = queries()["distinct_sequences"](spark, sf_dir).count()
    rows = queries()["routine_typology_60"](spark, sf_dir).collect()
    found = {r["cluster60"] for r in rows}
    assert found == set(range(1, len(found) + 1)) and min(days, 13) <= len(found) <= min(days, 60)
    assert all(r["description"] is not None for r in rows)
