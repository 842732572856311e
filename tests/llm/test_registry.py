"""Every SQL of the operators' queries is SQL, and gives the query's rows."""

import duckdb
import pytest

import __spark_entry__
from factloom.llm import registry

SF = "/root/testdata/sf0.001"


def test_oracles_are_sql_of_queries():
    for name, sql in __spark_entry__.oracle_sql().items():
        assert isinstance(sql, str) and name in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = c.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall()), key=repr)
