"""From requests to hits, responses and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.embedding import embed_hash
from passagemill.operators.filters import rejected_requests, valid_requests, validate_requests
from passagemill.operators.hits import hit_columns, prompts, to_answer_record
from passagemill.operators.search import attach_content, nearest, rerank
from passagemill.operators.userfuncs import answer
from passagemill.plans.ingest import Embedder
from passagemill.session import keep
from passagemill.settings import Settings
from passagemill.sources.requests import resolve_search_params


def prepare_requests(requests: DataFrame, settings: Settings = Settings(), embedder: Embedder = embed_hash) -> DataFrame:
    """Valid requests with resolved parameters and the vector of their text."""
    ready = resolve_search_params(valid_requests(validate_requests(requests)), settings)
    embedded = embedder(ready.withColumnRenamed("query", "content")).withColumnRenamed("content", "query")
    return embedded.select("q_id", "query", "k", "search_type", "fetch_k", "lambda_mult", "embedding")


def rank_requests(ready: DataFrame, store: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(q_id, rank, chunk_id, distance, file) by each request's own search type.

    One pass over the store finds the ``k`` nearest chunks of similarity
    requests and, with their vectors, the ``fetch_k`` candidates of the others.
    """
    diverse = F.col("search_type") == "mmr"
    budget = F.when(diverse, F.when(F.col("k") > 0, F.col("fetch_k"))).otherwise(F.col("k"))
    near = keep(nearest(ready.select("q_id", "embedding", budget.alias("k"), diverse.alias("carry")), store, settings.metric), "near")
    # Candidates of the one kind carry vectors, hits of the other do not.
    similar = near.where("vector IS NULL").drop("vector")
    return similar.unionByName(rerank(ready.where(diverse), near.where("vector IS NOT NULL")))


def search(
    requests: DataFrame, store: DataFrame, settings: Settings = Settings(), embedder: Embedder = embed_hash,
) -> DataFrame:
    """Hits of every valid request.

    ``requests`` has q_id and query and may have k, search_type, fetch_k and
    lambda_mult; what is absent comes from the settings.
    """
    # Used for both search types and for the join below, embedded once.
    ready = keep(prepare_requests(requests, settings, embedder), "requests")
    ranked = keep(rank_requests(ready, store, settings), "ranked")
    return hit_columns(attach_content(ranked, store, ready))


def answer_questions(
    requests: DataFrame, store: DataFrame, load: Callable[[], Callable[[str], str]], settings: Settings = Settings(),
    embedder: Embedder = embed_hash,
) -> DataFrame:
    """Questions in, answer records out: (q_id, query, answer, sources) of every request.

    ``load`` runs once per task and returns the function from prompt to text.
    A request that is rejected, or on which the function fails, has the error
    as its answer and no sources.
    """
    made, hits = build_prompts(requests, store, settings, embedder)
    # Asked once each, whatever is done with the records.
    answered = keep(answer(made, load).select("q_id", "query", "answer", "answered"), "answers")
    refused = rejected_requests(validate_requests(requests)).select(
        "q_id", "query", F.concat(F.lit("Error: "), "reason").alias("answer"), F.lit(False).alias("answered"))
    return to_answer_record(answered.unionByName(refused), hits, settings.preview_chars)


def build_prompts(
    requests: DataFrame, store: DataFrame, settings: Settings = Settings(), embedder: Embedder = embed_hash,
) -> tuple[DataFrame, DataFrame]:
    """(prompts, hits): one finished prompt per valid request, and its passages."""
    # Small beside the store, and needed for prompts and sources alike.
    hits = keep(search(requests, store, settings, embedder), "hits")
    asked = valid_requests(validate_requests(requests))
    return prompts(asked, hits, settings.prompt_template), hits
