import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from passagemill.operators.embedding import embed, embed_hash, sparse_terms, term_counts
from passagemill.operators.filters import rejected_requests, valid_requests, validate_requests
from passagemill.operators.hits import (
    collect_sources, files_fetched, hit_columns, hit_counts, prompts, stuff_context, to_answer_record, to_response,
)
from passagemill.operators.userfuncs import answer
from passagemill.settings import Settings
from passagemill.sources.requests import parse_requests, read_questions, resolve_search_params

BODIES = [
    (1, '{"query": "auth"}'),
    (2, '{"query": "auth", "k": 15, "search_type": "mmr", "fetch_k": 45, "lambda_mult": 0.5}'),
    (3, '{"query": "auth", "k": 20, "search_type": "similarity"}'),
    (4, '{"k": 1}'),
    (5, '{"query": "  "}'),
    (6, '{"query": " auth ", "k": 3}'),
    (7, '{"query": "x", "search_type": "other"}'),
    (8, '{"query": "x", "k": "7"}'),
    (9, "nope"),
    (10, '{"query": "x", "fetch_k": null, "k": 2}'),
    (11, None),
]


def test_requests(spark):
    checked = validate_requests(parse_requests(spark.createDataFrame(BODIES, "q_id long, body string")))
    got = {r["q_id"]: (r["query"], r["k"], r["search_type"], r["fetch_k"], r["lambda_mult"])
           for r in resolve_search_params(valid_requests(checked)).collect()}
    assert got == {
        1: ("auth", 15, "similarity", 45, 0.5), 2: ("auth", 15, "mmr", 45, 0.5), 3: ("auth", 20, "similarity", 60, 0.5),
        6: ("auth", 3, "similarity", 9, 0.5), 7: ("x", 15, "similarity", 45, 0.5), 8: ("x", 15, "similarity", 45, 0.5),
        10: ("x", 2, "similarity", 6, 0.5),
    }
    reasons = {r["q_id"]: r["reason"] for r in rejected_requests(checked).collect()}
    assert reasons == {4: "missing query", 5: "empty query", 9: "missing query", 11: "missing query"}


def test_settings_fill_absent_parameters(spark):
    asked = spark.createDataFrame([(1, "x")], "q_id long, query string")
    row = resolve_search_params(asked, Settings(k=5, search_type="mmr", fetch_k=8, lambda_mult=0.2)).first()
    assert (row["k"], row["search_type"], row["fetch_k"], row["lambda_mult"]) == (5, "mmr", 8, 0.2)


def test_questions(spark):
    rows = spark.createDataFrame([(1, " a \n"), (2, " \t"), (3, None)], "id long, line string")
    assert [tuple(r) for r in read_questions(rows, "line", "id").collect()] == [(1, "a")]


HITS = "q_id long, rank long, chunk_id string, content string, source string, file_name string, file_type string, file_size long, distance double"


@pytest.fixture
def hits(spark):
    return spark.createDataFrame([
        (1, 2, "b", "second", "/s/b.md", "b.md", ".md", 5, 0.2),
        (1, 1, "a", "f" * 201, "/s/a.md", "a.md", ".md", 4, 0.1),
        (2, 1, "c", 'quote " and\nline', None, None, None, None, None),
    ], HITS)


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "one?"), (2, "two?"), (3, "three?")], "q_id long, query string")


def by_id(df, column):
    return {r["q_id"]: r[column] for r in df.collect()}


def test_hit_columns_fill_missing_metadata(spark):
    found = spark.createDataFrame([(1, 1, "c", "t", None, 0.5)], "q_id long, rank long, chunk_id string, content string, path string, distance double")
    row = hit_columns(found).first()
    assert (row["source"], row["file_name"], row["file_type"], row["file_size"]) == ("Unknown", "Unknown", "Unknown", 0)


def test_counts_names_contexts(hits, asked):
    assert by_id(hit_counts(asked, hits), "hits") == {1: 2, 2: 1, 3: 0}
    assert by_id(files_fetched(hits), "file_names") == {1: ["a.md", "b.md"], 2: ["Unknown"]}
    assert by_id(stuff_context(hits), "context")[1] == "f" * 201 + "\n\n" + "second"
    assert by_id(stuff_context(hits, " it's\t"), "context")[1] == "f" * 201 + " it's\t" + "second"


def test_sources_and_responses(hits, asked):
    sources = by_id(collect_sources(hits), "sources")
    assert [s["content_preview"] for s in sources[1]] == ["f" * 200 + "...", "second"]
    responses = {q: json.loads(text) for q, text in by_id(to_response(asked, hits), "response").items()}
    assert responses[3] == {"query": "three?", "results": [], "count": 0}
    assert responses[2]["results"] == [{
        "content": 'quote " and\nline',
        "metadata": {"source": "Unknown", "file_name": "Unknown", "file_type": "Unknown", "file_size": 0}}]
    assert [r["content"][:6] for r in responses[1]["results"]] == ["ffffff", "second"] and responses[1]["count"] == 2


def test_answers(hits, asked):
    def load():
        def reply(prompt):
            if "two?" in prompt:
                raise RuntimeError("no model")
            return "fine"
        return reply

    made = prompts(asked, hits, "{context}|{question}")
    assert by_id(made, "prompt")[3] == "|three?"
    records = {r["q_id"]: r for r in to_answer_record(answer(made, load), hits).collect()}
    assert records[1]["answer"] == "fine" and [s["file_name"] for s in records[1]["sources"]] == ["a.md", "b.md"]
    assert records[2]["answer"] == "Error: no model" and records[2]["sources"] == []
    assert records[3]["sources"] == [] and records[3]["query"] == "three?"


def test_embedders(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, "Ab ab, AB-é"), (2, ""), (3, None)], "id long, content string")
    terms = {(r["id"], r["tf"]) for r in sparse_terms(rows, "id", 1).collect()}
    assert terms == {(1, 4)}
    unit = by_id(embed_hash(rows.withColumnRenamed("id", "q_id"), 16), "embedding")
    assert abs(sum(x * x for x in unit[1]) - 1) < 1e-6 and unit[2] == [0.0] * 16 and unit[3] is None

    own = by_id(embed(rows.withColumnRenamed("id", "q_id"), lambda: lambda texts: np.array([[len(t), 1] for t in texts]), 2), "embedding")
    assert own == {1: [11.0, 1.0], 2: [0.0, 1.0], 3: None}
    with pytest.raises(Exception, match="expected"):
        embed(rows, lambda: lambda texts: np.zeros((len(texts), 3)), 2).collect()


def test_remembered_tokens_stay_small():
    tracemalloc.start()
    try:
        for start in range(0, 600_000, 10_000):
            term_counts([" ".join(f"word{n}" for n in range(start, start + 10_000))])
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()
