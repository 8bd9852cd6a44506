"""The corpus queries that SQL expresses, against that SQL on the small tables."""

import duckdb
import pytest

from codegraph.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    said = c.execute(oracle_sql()[name])
    at = [[d[0] for d in said.description].index(x) for x in columns]
    want = sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=repr)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == want


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 13)]
