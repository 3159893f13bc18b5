"""The queries over the smallest tables, those with an SQL twin against it."""

import glob
import os

import duckdb
import pytest

from inkvane.llm import queries

FOLDER = os.environ.get("INKVANE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["record_id", "unit_id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id_a", "id_b"], "p5_found": ["axis", "category"], "p6_found": ["record_id", "start_pos", "end_pos"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(str, rows))) == len(rows)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(f"{FOLDER}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = con.sql(queries.oracle_sql()[name])
        assert want.columns == df.columns and sorted(map(tuple, rows)) == sorted(want.fetchall())
