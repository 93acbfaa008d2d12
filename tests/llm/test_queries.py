"""The registered queries over the smallest tables: their columns, rows and SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import rows_of

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash_near_dedup": "doc_id fingerprint component_id",
    "op2_benchmark_decontamination": "doc_id item_id item_tokens matched_tokens n_slots n_changed",
    "op3_line_dedup": "doc_id n_lines n_removed kept_sha256",
    "op4_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_html_extraction": "page_id url text n_chars",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_quality_classifier": "doc_id held_out score predicted",
    "op8_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_ngram_jaccard_join": "doc_id n_shingles component_id",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_all_are_registered():
    named = {name for name in entry.queries() if name.startswith("op") and name[2].isdigit() or name == "pipeline"}
    assert named == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name].split()
    sql = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    if name in entry.oracle_sql():
        result = sql.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())
    elif name not in ("op2_benchmark_decontamination", "op4_best_fit_packing", "pipeline"):
        table = {"op5": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
        assert sorted(r[0] for r in got) == sorted(r[0] for r in sql.execute(f"SELECT * FROM {table}").fetchall())
    else:
        assert got
