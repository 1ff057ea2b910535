"""The pN queries on the smallest tables: they run, give exactly the columns asked for, and agree with SQL where there is some."""

import duckdb
import pytest

from leafmill.llm.catalog import ORACLES, QUERIES

COLUMNS = {
    "p1_found": ["item_kind", "item_id", "end_char"], "p2_found": ["chunk_key", "case_kind"], "p3_found": ["src_id", "subject"], "p4_found": ["page_id", "line_no", "kind"],
    "p5_found": ["page_id_a", "page_id_b"], "p6_found": ["page_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_with_its_columns(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert name == "p7_ids" or len(rows) == len({tuple(r) for r in rows})
    if name not in ("p5_found", "p9_found"):
        assert rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("pdf_chunks", "split_specs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    want = con.execute(ORACLES[name]).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
