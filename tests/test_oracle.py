"""Every query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def key(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert cols == sorted(rel.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert key(got) == key(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
