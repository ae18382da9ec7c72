"""The queries of this subpackage that have SQL, against it."""

import duckdb
import pytest
from textloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted((tuple(r[k] for k in order) for r in got.collect()), key=repr) == sorted((tuple(r[want.columns.index(k)] for k in order) for r in want.fetchall()), key=repr)
