"""Queries with a SQL twin against it."""

import pytest
from conftest import SF_DIR

from tickloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == want
