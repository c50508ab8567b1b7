"""Every registered query of the engine's own operators against the SQL that stands beside it."""

import math

import pytest

import __spark_entry__ as entry
from panelspark import catalog

catalog.load()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def fix(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(fix, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(name, spark, data, duck):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(fix(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    kinds = {d[0]: str(d[1]) for d in r.description}
    assert sorted(at) == cols
    assert got == sorted((tuple(fix(x[at[c]]) for c in cols) for x in r.fetchall()), key=repr)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() >= 0  # ten suppliers share no nation, so pairs can be none


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
