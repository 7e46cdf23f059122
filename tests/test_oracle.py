"""Every query with SQL must return what DuckDB returns for it."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
HAVE = Path(SF).exists()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not HAVE, reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name.startswith("may_be_empty"), "no rows"
    if name in registry.oracle_sql():
        res = duck.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in res.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, res.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == b
