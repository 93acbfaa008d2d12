"""Counts of requests that do not fit, and counts beyond any store."""

from pyspark.sql import functions as F

from passagemill.functions.text import render_prompt
from passagemill.operators.filters import rejected_requests, valid_requests, validate_requests
from passagemill.operators.search import knn_batch, mmr
from passagemill.sources.requests import parse_requests, resolve_search_params


def parsed(spark, *bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "q_id long, body string")
    return validate_requests(parse_requests(rows))


def test_counts_are_taken_rejected_or_absent(spark):
    asked = parsed(
        spark, '{"query": "a", "k": 3000000000}', '{"query": "a", "k": 5.0}', '{"query": "a", "k": 5.5}', '{"query": "a", "k": 1e30}',
        '{"query": "a", "k": "7"}', '{"query": "a", "fetch_k": 2.5}', '{"query": "a", "k": 9223372036854775807}', '{"query": "", "k": 1.5}', 'nope')
    valid = resolve_search_params(valid_requests(asked))
    assert valid.schema["k"].dataType.simpleString() == "bigint"
    largest = (1 << 63) - 1
    assert {r.q_id: (r.k, r.fetch_k) for r in valid.collect()} == {
        0: (3_000_000_000, 9_000_000_000), 1: (5, 15), 4: (15, 45), 6: (largest, largest)}
    assert {r.q_id: r.reason for r in rejected_requests(asked).collect()} == {
        2: "k is no whole number that fits", 3: "k is no whole number that fits", 5: "fetch_k is no whole number that fits",
        7: "empty query", 8: "missing query"}


def test_a_count_beyond_the_store_gets_all_of_it(spark):
    store = spark.createDataFrame([(f"c{n}", [float(n), 1.0]) for n in range(30)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0], 1 << 62, 1 << 62, 0.5), (2, [3.0, 1.0], 2, 1 << 62, 0.5), (3, [3.0, 1.0], 2, 6, 0.5)],
                                  "q_id long, embedding array<double>, k long, fetch_k long, lambda_mult double")
    counts = lambda df: {r.q_id: r["count"] for r in df.groupBy("q_id").count().collect()}
    assert counts(knn_batch(asked, store)) == {1: 30, 2: 2, 3: 2}
    assert counts(mmr(asked, store)) == {1: 30, 2: 2, 3: 2}


def test_placeholders_may_stand_in_any_order(spark):
    row = spark.range(1).select(
        render_prompt(F.lit("C"), F.lit("Q"), "{x} {question} - {context} {context}").alias("a"),
        render_prompt(F.lit("C"), F.lit("Q"), "{context}{question}").alias("b")).first()
    assert tuple(row) == ("{x} Q - C {context}", "CQ")
