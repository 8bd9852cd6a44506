"""Every registered relational query, and those over a fixed tree, against their SQL, on the small tables."""

import math

import duckdb
import pytest

from codegraph.plans import queries as plans
from codegraph.plans import trees
from tests import fixture_queries as sources

FIXED = [{f"fixed_{name}": x for name, x in given.items()} for given in (sources.queries(), sources.oracle_sql())]
QUERIES, SQL = plans.queries() | trees.queries() | FIXED[0], plans.oracle_sql() | trees.oracle_sql() | FIXED[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    said = duck.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall()), key=repr)
    assert got == want
