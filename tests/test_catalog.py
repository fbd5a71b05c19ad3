"""Every registered query against its SQL twin."""

import math

import pytest
from conftest import SF_DIR

from tickloom.plans import catalog

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(v)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    rel = duck.sql(ORACLES[name])
    names = list(rel.columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == {c: str(t) for c, t in zip(names, rel.types)}
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())
    assert got == want
