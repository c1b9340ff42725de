"""Every registered corpus query on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

from tests.test_queries import SF, TABLES, rows
from thermalake.llm import queries

#: The columns that the queries return, and whether they return one row per document.
COLUMNS = {
    "op1": ("doc_id n_email n_ip n_card n_phone base_sha256 spans", True),
    "op2": ("doc_id n_lines n_dropped kept_sha256", True),
    "op3": ("doc_id start length ids_crc32 doc_tokens sequence_id offset", False),
    "op4": ("doc_id fingerprint component_id", True),
    "op5": ("doc_id size source_size target taken", True),
    "op6": ("vec_id n_links component_id kept", False),
    "op7": ("query_id rank vec_id score", False),
    "op8": ("doc_id held_out lang_pred score", True),
    "op9": ("doc_id held_out n_tokens n_known train_tokens base_score score", True),
    "op10": ("doc_id held_out score predicted", True),
    "op11": ("doc_id n_bytes n_removed n_spans kept_sha256", True),
    "op12": ("anchor_id positive_id rank negative_id positive_score negative_score", False),
    "op13": ("vec_id component n deviation whitened explained identity_error", False),
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    columns, per_document = COLUMNS[name.split("_")[0]]
    out = queries.queries()[name](spark, SF)
    assert out.columns == columns.split()
    got = out.toPandas()
    if per_document:
        ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
        assert sorted(got["doc_id"]) == sorted(ids["doc_id"])
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for table in TABLES.split():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(queries.oracle_sql()[name]).df()
        assert sorted(want.columns) == sorted(out.columns) and rows(got) == rows(want)
