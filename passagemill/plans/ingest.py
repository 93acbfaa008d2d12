"""From a folder of files to a store of embedded chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import wrap_content
from passagemill.operators.cards import csv_cards
from passagemill.operators.changes import merge_manifest
from passagemill.operators.chunking import chunk_recursive
from passagemill.operators.embedding import embed_hash
from passagemill.operators.filters import filter_changed, filter_nonblank, filter_size_cap, filter_visible
from passagemill.schemas import DOCUMENTS
from passagemill.session import keep, scratch, scratch_path
from passagemill.settings import Settings
from passagemill.sources.manifest import read_manifest, write_manifest
from passagemill.sources.rawfiles import (
    LISTING, hash_files, list_files, read_texts, with_file_columns, with_file_names,
)
from passagemill.sources.store import (
    as_store, bucket_count, create_store, load_store, store_exists, update_store,
)
from passagemill.sources.versions import newest_number

Embedder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IngestResult:
    documents: int
    chunks: int


def processed_at(moment: datetime | Column | None) -> Column:
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp") if moment is not None else F.current_timestamp()


def document_columns(files: DataFrame, at: Column) -> DataFrame:
    """Files with text -> the columns of a document (plus ``hash`` if there)."""
    renamed = files.withColumn("file_size", F.col("length")).withColumn("processed_at", at)
    extra = ["hash"] if "hash" in files.columns else []
    return renamed.select(*DOCUMENTS.names, *extra)


def load_documents(
    spark: SparkSession, root: str, manifest: DataFrame | None = None, settings: Settings = Settings(),
    image_text: Callable[[bytes], str] | None = None, moment: datetime | Column | None = None, work: str | None = None,
) -> DataFrame:
    """Document rows (with ``hash``) of every new or changed file under ``root``.

    Hidden and over-long files are dropped before a byte is read. With a
    manifest, files are first hashed where they lie and only the changed ones
    are read into rows; without one every file is read once. Paths and hashes
    are kept in ``work`` for as long as the result is used.
    """
    work = work or scratch_path(spark, "load")
    found = with_file_columns(list_files(spark, root, f"{work}/listing"), settings)
    wanted = filter_size_cap(filter_visible(found), settings.max_file_bytes)
    tables = hash_files(wanted.where("kind = 'csv'"))
    others = wanted.where("kind <> 'csv'")
    if manifest is not None:
        changed = filter_changed(hash_files(others), manifest).select("path", "length")
        others = keep(with_file_columns(changed, settings), "others", f"{work}/others")
        tables = filter_changed(tables, manifest)
    tables = keep(tables, "tables", f"{work}/tables")
    at = processed_at(moment)
    # Table files are described from their path; images without a function
    # for them yield no document.
    texts = with_file_names(read_texts(others, image_text, settings.encodings))
    wrapped = texts.withColumn("content", wrap_content(F.col("text"), F.col("kind"), F.col("file_type")))
    documents = document_columns(filter_nonblank(wrapped), at)
    if tables.isEmpty():
        return documents
    cards = csv_cards(tables, settings.preview_rows, settings.table_sep)
    described = with_file_names(tables.join(cards, "path"))
    return documents.unionByName(document_columns(filter_nonblank(described), at))


def chunks_with_vectors(documents: DataFrame, embedder: Embedder = embed_hash, settings: Settings = Settings()) -> DataFrame:
    chunks = chunk_recursive(documents, settings.chunk_size, settings.chunk_overlap, settings.separators)
    return as_store(embedder(chunks))


def processed_files(chunks: DataFrame) -> DataFrame:
    """Manifest rows of chunked documents; each has a first chunk."""
    return chunks.where("chunk_no = 0").select("path", "hash", "processed_at", F.col("file_size").alias("size"))


def ingest(
    spark: SparkSession, root: str, store: str, manifest: str, embedder: Embedder = embed_hash,
    settings: Settings = Settings(), image_text: Callable[[bytes], str] | None = None,
    moment: datetime | Column | None = None, drop_missing: bool = False,
) -> IngestResult:
    """Bring the store up to date with the folder: new and changed files only.

    A known file that has become blank or unreadable loses its chunks and its
    manifest entry; ``drop_missing`` does the same for files that are gone.
    Should another run have changed the manifest meanwhile, this one fails at
    the end and can be repeated.
    """
    base = newest_number(spark, manifest)
    before = read_manifest(spark, manifest)
    if before.isEmpty() and not store_exists(spark, store):
        return _build(spark, root, store, manifest, embedder, settings, image_text, moment)
    with scratch(spark, "ingest") as work:
        documents = load_documents(spark, root, before, settings, image_text, moment, work)
        chunks = keep(chunks_with_vectors(documents, embedder, settings), "chunks", f"{work}/chunks")
        result = _counted(chunks)
        touched = _touched(spark, work, before, drop_missing)
        if not touched.isEmpty():
            if store_exists(spark, store):
                update_store(chunks, store, touched)
            else:
                create_store(chunks, store, bucket_count(_text_bytes(spark, work)))
            # The manifest comes last: a run that fails before this point is
            # repeated in full by the next one.
            kept = before.join(touched, "path", "left_anti")
            write_manifest(merge_manifest(kept, processed_files(chunks)), manifest, base)
    return result


def _listing(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.schema(LISTING).parquet(f"{work}/listing/level=*").where("NOT is_dir")


def _text_bytes(spark: SparkSession, work: str) -> int:
    return _listing(spark, work).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _touched(spark: SparkSession, work: str, before: DataFrame, drop_missing: bool) -> DataFrame:
    """Paths whose chunks go: changed files, whatever came of them, and perhaps files that are gone."""
    paths = spark.read.schema("path string").parquet(f"{work}/others", f"{work}/tables")
    if drop_missing:
        paths = paths.unionAll(before.select("path").join(_listing(spark, work).select("path"), "path", "left_anti"))
    return keep(paths.distinct(), "touched", f"{work}/touched")


def rebuild(
    spark: SparkSession, root: str, store: str, manifest: str, embedder: Embedder = embed_hash,
    settings: Settings = Settings(), image_text: Callable[[bytes], str] | None = None,
    moment: datetime | Column | None = None,
) -> IngestResult:
    """Read everything again and replace store and manifest."""
    result = _build(spark, root, store, manifest, embedder, settings, image_text, moment)
    if result.documents == 0:
        raise ValueError(f"no documents found under {root}")
    return result


def _build(spark, root, store, manifest, embedder, settings, image_text, moment) -> IngestResult:
    """Files to a new store in one pass over their bytes."""
    with scratch(spark, "build") as work:
        documents = load_documents(spark, root, None, settings, image_text, moment, work)
        if documents.isEmpty():
            return IngestResult(0, 0)
        create_store(chunks_with_vectors(documents, embedder, settings), store, bucket_count(_text_bytes(spark, work)))
    chunks = load_store(spark, store)
    write_manifest(processed_files(chunks), manifest)
    return _counted(chunks)


def _counted(chunks: DataFrame) -> IngestResult:
    row = chunks.agg(F.count_if(F.col("chunk_no") == 0).alias("documents"), F.count(F.lit(1)).alias("chunks")).first()
    return IngestResult(row["documents"], row["chunks"])
