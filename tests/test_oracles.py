"""Every query with an SQL twin gives the twin's rows on the smallest tables; every other one gives rows."""

import glob
import os

import duckdb
import pytest

import inkvane.catalog as catalog

FOLDER = os.environ.get("INKVANE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return format(round(v, 8) + 0.0, ".9g")
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got, want = df.collect(), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = [[df.columns.index(c) for c in sorted(df.columns)], [want.columns.index(c) for c in sorted(want.columns)]]
    assert sorted(repr([norm(r[i]) for i in a]) for r in got) == sorted(repr([norm(r[i]) for i in b]) for r in want.fetchall())


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_analyze_bundle(spark):
    rows = catalog.queries()["analyze_bundle"](spark, FOLDER).select("reason", "label", "confidence", "evidence.sentence_heat.kind").collect()
    assert rows and all((r["reason"] is None) == (r["label"] is not None) for r in rows)
    assert {r["kind"] for r in rows if r["label"]} == {"model"}
