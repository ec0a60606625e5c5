"""Every query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import tallyfield.plans.forecasts  # noqa: F401
import tallyfield.plans.models  # noqa: F401
import tallyfield.plans.more  # noqa: F401
import tallyfield.plans.relational  # noqa: F401
import tallyfield.plans.streams  # noqa: F401
import tallyfield.plans.systems  # noqa: F401
from tallyfield.registry import ORACLE, QUERIES


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 7) + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(norm, x))
    return x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(ORACLE[name])
    have = [x[0] for x in rel.description]
    assert cols == sorted(have)
    at = [have.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    """Rows of the queries without SQL: there are some, keys are set and numbers are finite."""
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
    for r in rows:
        for c in df.columns:
            if isinstance(r[c], float):
                assert math.isfinite(r[c]), c
            elif c in ("player_id", "position", "season", "week", "col", "team"):
                assert r[c] is not None, c
