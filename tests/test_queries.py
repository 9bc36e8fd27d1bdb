"""Queries against their DuckDB twins on the smallest data set; the driver compares all of them on a larger one."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
SOME = "ship_status ship_defect_counts canon_names canon_ports container_parse weight_parse email_classify field_extract_fold doc_kind html_to_text prior_upsert quality_rules ocr_consensus evidence_best_line snap_names_top1 snap_places_top1 lcs_ratio port_alias_lookup json_resolution_parse dup_filenames evidence_boxes inbox_ordinals photo_pages_joined upload_documents pdf_text_lines page_numbers dashboard_totals failed_messages page_items safe_numbers".split()


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no data")
@pytest.mark.parametrize("name", SOME)
def test_twin(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = __spark_entry__.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
