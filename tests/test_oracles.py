"""Every core query with SQL is held against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from missive.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def shown(rows):
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert shown(map(tuple, df.select(*cols).collect())) == shown(want)
