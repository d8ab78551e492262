"""The queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from mvspark.llm import queries

TABLES = ("documents", "pages", "benchmark")


@pytest.mark.parametrize("data", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name, data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{data}/{t}.parquet')")
    want = c.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, f"/root/testdata/{data}")
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda names, found: sorted((tuple(r[names.index(n)] for n in order) for r in found), key=repr)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_whole_tables_come_back(spark):
    data = "/root/testdata/sf0.001"
    for name, query in queries.QUERIES.items():
        if name == "op1_token_counts":
            continue  # a row for each section
        t = {"op2_url_filter": "pages", "op7_embeddings": "embeddings"}.get(name, "documents")
        assert query(spark, data).count() == spark.read.parquet(f"{data}/{t}.parquet").count(), name


def test_contract_columns(spark):
    data = "/root/testdata/sf0.001"
    want = {
        "op2_url_filter": "page_id host path rule verdict",
        "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op5_token_store": "doc_id start n_tokens ids_crc32",
        "op6_language": "doc_id held_out lang_pred score",
        "op7_embeddings": "vec_id n_links component_id kept",
        "op8_toxicity": "doc_id held_out score predicted",
        "op9_simhash": "doc_id fingerprint component_id",
    }
    kinds = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean", "n_email": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_links": "bigint", "component_id": "bigint", "kept": "boolean", "fingerprint": "string", "verdict": "string"}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, data)
        assert df.columns[: len(columns.split())] == columns.split(), name
        for c, kind in df.dtypes:
            assert kinds.get(c, kind) == kind, (name, c, kind)
