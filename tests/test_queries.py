"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

import glob
import numbers
import os

import pytest

import __spark_entry__ as entry
from leafspark import plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, numbers.Number) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
