"""Every query with SQL gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1 << 50 else str(value)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, db, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    expected = db.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    got = sorted([[plain(v) for v in row] for row in found.select(*[f"`{n}`" for n in names]).collect()], key=str)
    want = sorted([[plain(v) for v in row] for row in expected.fetchall()], key=str)
    assert len(got) == len(want)
    assert got == want
    assert got or name in {"metric_mismatch"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    if name.startswith(("op", "pipeline")):
        pytest.skip("tested in tests/llm")
    assert QUERIES[name](spark, sf_dir).count() > 0
