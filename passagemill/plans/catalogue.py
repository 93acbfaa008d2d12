"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.functions.paths import file_name
from passagemill.functions.text import (
    content_hash, content_preview, decode_text, render_prompt, row_to_text, wrap_content,
)
from passagemill.operators.cards import csv_cards, table_card
from passagemill.operators.cells import knn_cells, write_cells
from passagemill.operators.changes import detect_changes, ingest_counts, merge_manifest, replace_chunks
from passagemill.operators.chunking import chunk_fixed, chunk_recursive
from passagemill.operators.embedding import embed, embed_hash, embed_word2vec, fit_word2vec, known_words, sparse_terms
from passagemill.operators.filters import (
    filter_changed, filter_nonblank, filter_size_cap, filter_visible, rejected_requests, valid_requests, validate_requests,
)
from passagemill.operators.hits import (
    collect_sources, files_fetched, hit_columns, hit_counts, prompts, stuff_context, to_answer_record, to_response,
)
from passagemill.operators.search import attach_content, knn_batch, knn_topk, mmr, sparse_search
from passagemill.operators.status import store_info, store_status
from passagemill.operators.termindex import search_terms, write_term_index
from passagemill.operators.userfuncs import answer, extract_text
from passagemill.plans import inputs as I
from passagemill.plans.ingest import document_columns, ingest, load_documents, rebuild
from passagemill.plans.search import answer_questions, build_prompts, prepare_requests, search
from passagemill.schemas import DOCUMENTS
from passagemill.session import delete_path, keep, scratch_path
from passagemill.settings import PROMPT_TEMPLATE, Settings
from passagemill.sources.csvfiles import scan_csv
from passagemill.sources.manifest import read_manifest, write_manifest
from passagemill.sources.rawfiles import list_files, scan_files
from passagemill.sources.requests import parse_requests, read_questions, resolve_search_params
from passagemill.sources.store import append_store, as_store, compact_store, create_store, load_store, reload_store, update_store
from passagemill.streaming.ingest import ingest_stream
from passagemill.streaming.search import search_stream

# Character windows only, so that the chunks can be restated in SQL.
WINDOWS = Settings(separators=("",))
JOINED = Settings(k=15, metric="l2")


def _distance(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


# Files and documents

def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filter_size_cap(filter_visible(I.files(spark, sf_dir)), 1500)
    return kept.select("path", "file_name", "file_type", "kind")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text").cast("binary")).alias("hash"))


def change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_changes(I.files(spark, sf_dir), I.manifest(spark, sf_dir)).select("path", "status")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_changed(I.files(spark, sf_dir), I.manifest(spark, sf_dir)).select("path", "hash")


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = I.files(spark, sf_dir).select(
        "path", "hash", F.to_timestamp(F.lit("2026-02-01 00:00:00")).alias("processed_at"), (F.col("length") + 1).alias("size")
    )
    merged = merge_manifest(I.manifest(spark, sf_dir), processed)
    return merged.withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss"))


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.files(spark, sf_dir)
    wrapped = files.withColumn("content", wrap_content(F.col("text"), F.col("kind"), F.col("file_type")))
    documents = document_columns(filter_nonblank(wrapped), I.moment())
    return documents.withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss"))


def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    customers = I.table(spark, sf_dir, "customer").select(*columns)
    blanked = customers.withColumn("c_name", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return blanked.select("c_custkey", row_to_text(columns).alias("line"))


def table_card_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = I.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return table_card(customers, "customer.csv", "c_custkey")


def decode_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(
        F.encode(F.regexp_replace(text, "\n", "\r\n"), "UTF-16")
    )
    return I.spread_table(spark, sf_dir, "documents").select("doc_id", decode_text(raw).alias("content"))


def scan_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = I.corpus_folder(spark, sf_dir)
    return scan_files(spark, root).select(
        F.expr(f"substring(path, {len(root) + 2})").alias("path"), "length", F.col("content").cast("string").alias("content"), "hash"
    )


def scan_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_csv(spark, I.customer_tables(spark, sf_dir))
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"),
                       "c_mktsegment", F.regexp_extract("source_path", "block=([0-9]+)/", 1).alias("folder"))


def csv_cards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = list_files(spark, I.customer_tables(spark, sf_dir)).where("path like '%.csv' and path not like '%/.%'")
    return csv_cards(files).select(
        F.regexp_extract("path", r"/block=(\d+)/", 1).cast("long").alias("block"),
        F.regexp_replace("content", r"^CSV File: [^\n]*", "CSV File: part").alias("content"),
    )


def _relative(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("path", F.expr(f"substring(path, {len(root) + 2})"))


def load_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = I.corpus_folder(spark, sf_dir)
    documents = load_documents(spark, root, settings=Settings(max_file_bytes=4000))
    return _relative(documents, root).select("path", "file_name", "file_type", "file_size", "content", "hash")


def ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over an older state of the labelled files, then an update."""
    root = scratch_path(spark, "corpus")
    store, manifest = scratch_path(spark, "store"), scratch_path(spark, "manifest")
    rows = I.corpus_rows(spark, sf_dir, root)
    labelled = rows.join(I.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    older = F.when(F.col("quality") == 1, F.col("content")).otherwise(F.concat(F.lit("older "), F.col("content")))
    I.write_files(labelled.withColumn("content", older))
    ingest(spark, root, store, manifest, settings=WINDOWS)
    I.write_files(rows)
    ingest(spark, root, store, manifest, settings=WINDOWS)
    known = read_manifest(spark, manifest).select("path", "hash", "size")
    chunks = reload_store(spark, store).select("path", "chunk_no", "content", F.size("embedding").cast("long").alias("dimension"))
    return _relative(chunks.join(known, "path"), root)


def rebuild_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the labelled files only, replaced by one of all files."""
    root, other = I.corpus_folder(spark, sf_dir), scratch_path(spark, "corpus")
    store, manifest = scratch_path(spark, "store"), scratch_path(spark, "manifest")
    rows = I.corpus_rows(spark, sf_dir, other)
    I.write_files(rows.join(I.table(spark, sf_dir, "labels").select("doc_id"), "doc_id"))
    rebuild(spark, other, store, manifest, settings=WINDOWS)
    rebuild(spark, root, store, manifest, settings=WINDOWS)
    known = read_manifest(spark, manifest).select("path", "hash", "size")
    chunks = reload_store(spark, store).select("path", "chunk_no", "content", F.size("embedding").cast("long").alias("dimension"))
    return _relative(chunks.join(known, "path"), root)


# Chunks and vectors

def chunk_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fixed(I.text_documents(spark, sf_dir)).select("path", "chunk_no", "chunk_id", "content", "file_type")


def chunk_recursive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recursive(I.text_documents(spark, sf_dir)).select("path", "chunk_no", "chunk_id", "content", "file_type")


def chunk_recursive_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunks cut at the default separators, without overlap, hold of every document: all but white space at their ends."""
    chunks = chunk_recursive(I.text_documents(spark, sf_dir), 300, 0)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda c: c["content"])
    solid = F.regexp_replace(F.array_join(parts, ""), r"\s", "")
    # A chunk has under 300 characters, or is a piece of 300 of a longer word.
    return chunks.groupBy("path").agg(
        F.md5(solid).alias("solid"), (F.max(F.length("content")) <= 300).alias("all_fit"), (F.min("chunk_no") == 0).alias("from_zero"),
        (F.max("chunk_no") == F.count("*") - 1).alias("gapless"),
        F.max((F.regexp_replace("content", r"^\s+|\s+$", "") != F.col("content")).cast("int")).cast("long").alias("untrimmed"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_recursive(I.text_documents(spark, sf_dir), 700, 300, separators=("",))
    return chunks.select("path", "chunk_no", "chunk_id", "content")


def embed_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_terms(I.spread_table(spark, sf_dir, "documents"), "doc_id", text_col="text")


def embed_hash_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = embed_hash(I.spread_table(spark, sf_dir, "documents"), text_col="text")
    return unit.select(
        "doc_id",
        F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ",").alias("vector"),
    )


def _load_counter():
    import numpy as np

    vowels = frozenset("aeiou")
    return lambda texts: np.array([[len(t), sum(c in vowels for c in t)] for t in texts], dtype="float32").reshape(-1, 2)


def embed_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = embed(I.spread_table(spark, sf_dir, "documents"), _load_counter, 2, text_col="text")
    return embedded.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("characters"), F.col("embedding")[1].cast("double").alias("vowels")
    )


def embed_word2vec_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = I.spread_table(spark, sf_dir, "documents")
    model = fit_word2vec(documents, dim=16, text_col="text")
    return embed_word2vec(documents, model, text_col="text").select("doc_id", F.size("embedding").alias("dimension"), "embedding")


def word2vec_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those that were learnt, and whether it has a vector."""
    documents = I.spread_table(spark, sf_dir, "documents")
    model = fit_word2vec(documents, dim=16, text_col="text")
    vectors = embed_word2vec(documents, model, text_col="text").select(
        "doc_id", F.size("embedding").cast("long").alias("dimension"), F.exists("embedding", lambda x: x != 0).alias("has_vector"))
    return known_words(documents, model, "doc_id", "text").join(vectors, "doc_id")


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the centre of its label."""
    vectors = I.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("q_id"), F.col("embedding").alias("a"))
    pairs = vectors.join(I.vector_requests(spark, sf_dir).select("q_id", F.col("embedding").alias("b")), "q_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "vec_id", F.round(V.l2_squared(a, b), 6).alias("l2"), F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.norm(b), 6).alias("norm"), F.round(V.cosine(a, b), 6).alias("cosine"),
        F.round(V.normalise(b)[0], 6).alias("first_of_unit"),
    )


# Search

def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors to the centre of all vectors."""
    centre = I.table(spark, sf_dir, "embeddings").agg(
        F.array(*[F.avg(F.col("embedding")[n].cast("double")) for n in range(I.VECTOR_DIM)]).alias("centre")
    ).first()["centre"]
    return _distance(knn_topk(centre, I.vector_store(spark, sf_dir), 15))


def knn_batch_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(knn_batch(I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir)))


def knn_batch_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(knn_batch(I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir), "cosine"))


def knn_batch_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(knn_batch(I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir), "dot"))


def knn_batch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when the requests are too many to broadcast."""
    return _distance(knn_batch(
        I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir), "l2", broadcast_bytes=8 * I.VECTOR_DIM * 3
    ))


def _in_cells(spark: SparkSession, sf_dir: str, metric: str, **options) -> DataFrame:
    path = scratch_path(spark, "cells")
    write_cells(I.vector_store(spark, sf_dir), path, metric, cells=32)
    return _distance(knn_cells(I.vector_requests(spark, sf_dir), path, metric, **options))


def knn_cells_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors from a store in metric cells."""
    return _in_cells(spark, sf_dir, "l2")


def knn_cells_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the cosine, with requests in several blocks."""
    return _in_cells(spark, sf_dir, "cosine", broadcast_bytes=8 * I.VECTOR_DIM * 3)


def mmr_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(mmr(I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir)))


def mmr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when ``fetch_k`` is too large to re-rank in one task."""
    return _distance(mmr(I.vector_requests(spark, sf_dir), I.vector_store(spark, sf_dir), group_bytes=8 * I.VECTOR_DIM * 20, ahead=6))


def mmr_lambda_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = I.vector_requests(spark, sf_dir).withColumn("lambda_mult", F.lit(1.0))
    return _distance(mmr(requests, I.vector_store(spark, sf_dir)))


def requests_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = validate_requests(parse_requests(I.request_bodies(spark, sf_dir)))
    return resolve_search_params(valid_requests(parsed)).select("q_id", "query", "k", "search_type", "fetch_k", "lambda_mult")


def requests_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_requests(validate_requests(parse_requests(I.request_bodies(spark, sf_dir)))).select("q_id", "reason")


def read_questions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = I.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("\t "), F.expr("if(role = 'user', text, '')"), F.lit(" \n")).alias("line"),
    )
    return read_questions(turns, "line", "id")


def _question_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All user questions and their nearest document chunks."""
    asked = I.questions(spark, sf_dir)
    ready = keep(prepare_requests(asked, JOINED), "requests")
    store = I.saved_document_store(spark, sf_dir)
    ranked = knn_batch(ready, store, JOINED.metric)
    return asked, hit_columns(attach_content(ranked, store, ready))


def sparse_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = I.questions(spark, sf_dir).withColumn("k", F.lit(10))
    return _distance(sparse_search(asked, chunk_fixed(I.text_documents(spark, sf_dir))))


def _term_index(spark: SparkSession, sf_dir: str, dim: int) -> DataFrame:
    path = scratch_path(spark, "terms")
    write_term_index(chunk_fixed(I.text_documents(spark, sf_dir)), path, dim)
    return _distance(search_terms(spark, I.questions(spark, sf_dir).withColumn("k", F.lit(10)), path, dim))


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by shared terms over an index of the chunks."""
    return _term_index(spark, sf_dir, 64)


def term_index_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with so many dimensions that terms hardly collide."""
    return _term_index(spark, sf_dir, 1 << 18)


def question_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(_question_hits(spark, sf_dir)[1])


def hit_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_counts(*_question_hits(spark, sf_dir))


def files_fetched_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = files_fetched(_question_hits(spark, sf_dir)[1])
    return named.select("q_id", F.array_join("file_names", ",").alias("file_names"))


def stuffed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuff_context(_question_hits(spark, sf_dir)[1])


def prompts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = build_prompts(I.questions(spark, sf_dir), I.saved_document_store(spark, sf_dir), JOINED)
    return made


def _flat_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["source"], s["file_name"], s["file_type"], s["content_preview"])), "#"))


def source_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_sources(collect_sources(_question_hits(spark, sf_dir)[1]))


def hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _question_hits(spark, sf_dir)
    parsed = to_response(asked, hits).select("q_id", F.from_json(
        "response", "query string, count long, results array<struct<content:string,metadata:struct<source:string,file_name:string,file_type:string,file_size:long>>>"
    ).alias("r"))
    line = F.transform("r.results", lambda h: F.concat_ws(
        "|", h["metadata"]["source"], h["metadata"]["file_name"], h["metadata"]["file_type"], h["metadata"]["file_size"].cast("string"), h["content"]
    ))
    return parsed.select("q_id", "r.query", "r.count", F.array_join(line, "#").alias("results"))


def _load_echo():
    def reply(prompt: str) -> str:
        if len(prompt) % 2:
            raise RuntimeError("odd prompt")
        return f"{len(prompt)} characters"

    return reply


def answers_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = build_prompts(I.questions(spark, sf_dir), I.saved_document_store(spark, sf_dir), JOINED)
    return answer(made, _load_echo).select("q_id", "query", "answer", "answered")


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _question_hits(spark, sf_dir)
    hits = keep(hits, "hits")
    answered = answer(prompts(asked, hits), _load_echo)
    return _flat_sources(to_answer_record(answered, hits))


def answer_questions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, store = I.questions(spark, sf_dir), I.saved_document_store(spark, sf_dir)
    return _flat_sources(answer_questions(asked, store, _load_echo, JOINED))


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = parse_requests(I.request_bodies(spark, sf_dir)).drop("body")
    return _distance(search(requests, I.saved_document_store(spark, sf_dir)))


# Store, manifest, status, streams

def store_info_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_info(I.vector_store(spark, sf_dir), by_type=True)


def ingest_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = I.text_documents(spark, sf_dir)
    return ingest_counts(documents, chunk_fixed(documents))


def replace_chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of quality 0 get new, shorter chunks."""
    documents = I.text_documents(spark, sf_dir)
    changed = I.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("path"))
    store = chunk_fixed(documents)
    renewed = chunk_fixed(documents.join(changed, "path", "left_semi"), 500, 100)
    return replace_chunks(store, renewed).select("path", "chunk_no", "content")


def _joined_words(raw: bytes) -> str:
    text = raw.decode("utf-8")
    if text.startswith("E"):
        raise ValueError("unreadable image")
    return text.replace(" ", "_")


def extract_text_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = I.files(spark, sf_dir).where("kind = 'image'")
    return images.select("path", extract_text(F.col("text").cast("binary"), _joined_words).alias("content"))


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    first = I.manifest(spark, sf_dir)
    write_manifest(first, path)
    write_manifest(read_manifest(spark, path).withColumn("size", F.col("size") + 1), path)
    return read_manifest(spark, path).withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss"))


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents create the store, the others are appended."""
    path = scratch_path(spark, "store")
    chunks = I.document_store(spark, sf_dir)
    labelled = I.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    create_store(chunks.join(labelled, "path", "left_semi"), path)
    before = load_store(spark, path)
    append_store(chunks.join(labelled, "path", "left_anti"), path)
    after = reload_store(spark, path)
    assert before is not None and after is not None
    return after.select("path", "chunk_no", "chunk_id", "content", "file_size", F.size("embedding").cast("long").alias("dimension"))


def compact_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of low quality are replaced, toxic ones removed, and the store is compacted."""
    path = scratch_path(spark, "store")
    create_store(I.document_store(spark, sf_dir), path)
    labels = I.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality", "toxic")
    poor = labels.where("quality = 0 AND toxic = 0")
    fresh = I.text_documents(spark, sf_dir).join(poor, "path", "left_semi") \
        .withColumn("content", F.concat(F.lit("seen as "), "file_type"))
    update_store(as_store(embed_hash(chunk_fixed(fresh))), path)
    update_store(I.document_store(spark, sf_dir).limit(0), path, labels.where("toxic = 1"))
    compact_store(spark, path)
    return load_store(spark, path).select("path", "chunk_no", "content")


def store_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = scratch_path(spark, "store"), scratch_path(spark, "manifest")
    create_store(I.document_store(spark, sf_dir), path)
    status = store_status(spark, path, manifest, sf_dir)
    return status.select("store_exists", "store_loaded", "manifest_exists", "folder_exists")


def ingest_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, store = scratch_path(spark, "arrivals"), scratch_path(spark, "store")
    I.text_documents(spark, sf_dir).write.parquet(source)
    arriving = spark.readStream.schema(DOCUMENTS).parquet(source)
    ingest_stream(arriving, store, scratch_path(spark, "progress"), settings=WINDOWS).awaitTermination()
    return reload_store(spark, store).select("path", "chunk_no", "chunk_id", "content")


def search_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, store, output = (scratch_path(spark, label) for label in ("bodies", "store", "hits"))
    I.request_bodies(spark, sf_dir).write.parquet(bodies)
    create_store(I.document_store(spark, sf_dir), store)
    arriving = spark.readStream.schema("q_id long, body string").parquet(bodies)
    search_stream(arriving, store, output, scratch_path(spark, "progress")).awaitTermination()
    return _distance(spark.read.parquet(f"{output}/batch=*"))


def stream_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever was asked gets a reply."""
    bodies, store, output, replies = (scratch_path(spark, label) for label in ("bodies", "store", "hits", "replies"))
    I.request_bodies(spark, sf_dir).write.parquet(bodies)
    create_store(I.document_store(spark, sf_dir), store)
    arriving = spark.readStream.schema("q_id long, body string").parquet(bodies)
    search_stream(arriving, store, output, scratch_path(spark, "progress"), replies=replies).awaitTermination()
    found = F.get_json_object("response", "$.count").cast("long")
    return spark.read.parquet(f"{replies}/batch=*").select("q_id", "status", "reason", found.alias("hits"))


def ingest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files already in the store, some turn blank, some vanish and some change."""
    root = I.corpus_folder(spark, sf_dir)
    store, manifest = scratch_path(spark, "store"), scratch_path(spark, "manifest")
    ingest(spark, root, store, manifest, settings=WINDOWS)
    rows = I.corpus_rows(spark, sf_dir, root).join(I.table(spark, sf_dir, "labels"), "doc_id")
    text = F.when(F.col("quality") == 0, " \n").otherwise(F.concat(F.lit("again "), "source_name"))
    rows = rows.withColumn("source_name", F.element_at(F.split("path", "/"), -1)).where("quality = 0 OR toxic = 1")
    I.write_files(rows.select("path", text.alias("content")))
    delete_path(spark, f"{root}/src0")
    ingest(spark, root, store, manifest, settings=WINDOWS, drop_missing=True)
    return load_store(spark, store).select("file_name", "chunk_no", "content")


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", content_preview(F.col("text")).alias("preview"))


def rendered_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", render_prompt(F.col("text"), file_name(F.col("source")), PROMPT_TEMPLATE).alias("prompt")
    )


QUERIES = {
    "file_kinds": file_kinds,
    "content_hashes": content_hashes,
    "change_status": change_status,
    "changed_files": changed_files,
    "manifest_merge": manifest_merge,
    "wrapped_documents": wrapped_documents,
    "row_text": row_text,
    "table_card": table_card_query,
    "decode_text": decode_text_query,
    "scan_files": scan_files_query,
    "csv_cards": csv_cards_query,
    "scan_csv": scan_csv_query,
    "load_documents": load_documents_query,
    "ingest": ingest_query,
    "rebuild": rebuild_query,
    "chunk_fixed": chunk_fixed_query,
    "chunk_recursive": chunk_recursive_query,
    "chunk_windows": chunk_windows,
    "chunk_recursive_cover": chunk_recursive_cover,
    "embed_hash": embed_hash_query,
    "embed_hash_unit": embed_hash_unit,
    "embed_user": embed_user,
    "embed_word2vec": embed_word2vec_query,
    "word2vec_cover": word2vec_cover,
    "vector_functions": vector_functions,
    "knn_single": knn_single,
    "knn_batch_l2": knn_batch_l2,
    "knn_batch_cosine": knn_batch_cosine,
    "knn_batch_dot": knn_batch_dot,
    "knn_batch_grid": knn_batch_grid,
    "knn_cells_l2": knn_cells_l2,
    "knn_cells_cosine": knn_cells_cosine,
    "mmr": mmr_query,
    "mmr_rounds": mmr_rounds,
    "mmr_lambda_1": mmr_lambda_1,
    "requests_valid": requests_valid,
    "requests_rejected": requests_rejected,
    "read_questions": read_questions_query,
    "sparse_search": sparse_search_query,
    "term_index": term_index,
    "term_index_wide": term_index_wide,
    "question_hits": question_hits,
    "hit_counts": hit_counts_query,
    "files_fetched": files_fetched_query,
    "stuffed_context": stuffed_context,
    "prompts": prompts_query,
    "source_previews": source_previews,
    "hits_json": hits_json,
    "answers_echo": answers_echo,
    "answer_records": answer_records,
    "answer_questions": answer_questions_query,
    "stream_replies": stream_replies,
    "ingest_changes": ingest_changes,
    "search": search_query,
    "store_info": store_info_query,
    "ingest_counts": ingest_counts_query,
    "replace_chunks": replace_chunks_query,
    "extract_text_user": extract_text_user,
    "manifest_roundtrip": manifest_roundtrip,
    "store_roundtrip": store_roundtrip,
    "compact_store": compact_store_query,
    "store_status": store_status_query,
    "ingest_stream": ingest_stream_query,
    "search_stream": search_stream_query,
    "content_previews": previews,
    "rendered_prompt": rendered_prompt,
}
