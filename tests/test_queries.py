"""Every registered query of the engine that has SQL, against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENGINE = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")]


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return repr(x)


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the tables")
@pytest.mark.parametrize("name", ENGINE)
def test_query_equals_its_sql(spark, views, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = views.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == rows
    assert rows or name in ("forbidden_hits", "scope_projection", "test_links"), "the smallest tables give no row to these three alone"
