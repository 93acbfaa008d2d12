"""Operator inputs derived from the driver's tables, whole tables throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.chunking import chunk_fixed
from passagemill.operators.embedding import embed_hash
from passagemill.session import keep, scratch_path, spread_small
from passagemill.settings import Settings
from passagemill.sources.rawfiles import open_filesystem, with_file_columns
from passagemill.sources.store import as_store

MOMENT = "2026-01-01 00:00:00"
VECTOR_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that feeds heavy per-row work."""
    return spread_small(table(spark, sf_dir, name))


def moment():
    return F.to_timestamp(F.lit(MOMENT))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file row, over all kinds of names."""
    extension = F.element_at(
        F.array(*[F.lit(e) for e in (".md", ".py", ".csv", ".png", "", ".LOG")]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    name = F.when(extension == "", "README").otherwise(
        F.concat(F.when(F.col("doc_id") % 11 == 0, ".h").otherwise("f"), extension)
    )
    return with_file_columns(
        table(spark, sf_dir, "documents").select(
            F.concat_ws("/", F.lit("/corpus"), "source", F.col("doc_id").cast("string"), name).alias("path"),
            F.col("n_chars").alias("length"), F.col("text"), F.md5("text").alias("hash"),
        ),
        Settings(),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as known files (an older state where quality is 0),
    and web pages as known files that are gone."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    known = files(spark, sf_dir).withColumn("doc_id", F.element_at(F.split("path", "/"), -2).cast("long")).join(labels, "doc_id")
    old = F.md5(F.concat(F.lit("old"), F.col("text")))
    gone = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("path"), F.md5("html").alias("hash"),
        moment().alias("processed_at"), F.length("html").cast("long").alias("size"),
    )
    return known.select(
        "path", F.when(F.col("quality") == 1, F.col("hash")).otherwise(old).alias("hash"),
        moment().alias("processed_at"), F.col("length").alias("size"),
    ).unionByName(gone)


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as document rows, one path each."""
    return spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_name"),
        F.concat(F.lit("."), "lang").alias("file_type"), F.col("n_chars").alias("file_size"),
        F.col("text").alias("content"), moment().alias("processed_at"),
    )


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of all documents with their hashed vectors."""
    return as_store(embed_hash(chunk_fixed(text_documents(spark, sf_dir))))


def saved_document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_store`` written once, for plans that read it several times."""
    return keep(document_store(spark, sf_dir), "document-store")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations that a user wrote."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("q_id"), F.col("text").alias("query")
    )


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding",
        F.concat(F.lit("/labels/"), F.col("label").cast("string")).alias("path"),
        F.concat(F.lit("."), F.col("label").cast("string")).alias("file_type"),
    )


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per label: the centre of all its vectors."""
    centre = F.array(*[F.avg(F.col("embedding")[n].cast("double")) for n in range(VECTOR_DIM)])
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("q_id")).agg(
        centre.alias("embedding")
    ).select(
        "q_id", "embedding", (F.col("q_id") + 6).cast("int").alias("k"), (F.col("q_id") * 3 + 18).cast("int").alias("fetch_k"),
        F.lit(0.5).alias("lambda_mult"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON request of some kind from every benchmark text."""
    text = F.col("text")
    kind = F.col("item_id") % 8
    padded = F.concat(F.lit(" "), text, F.lit("\n"))
    body = (
        F.when(kind == 0, F.to_json(F.struct(text.alias("query"))))
        .when(kind == 1, F.to_json(F.struct(
            text.alias("query"), F.lit(5).alias("k"), F.lit("mmr").alias("search_type"),
            F.lit(12).alias("fetch_k"), F.lit(0.25).alias("lambda_mult"))))
        .when(kind == 2, F.to_json(F.struct(text.alias("query"), F.lit(20).alias("k"), F.lit("similarity").alias("search_type"))))
        .when(kind == 3, F.to_json(F.struct(F.length(text).alias("k"))))
        .when(kind == 4, F.to_json(F.struct(F.lit(" \n ").alias("query"), F.length(text).alias("k"))))
        .when(kind == 5, F.to_json(F.struct(padded.alias("query"), F.lit(3).alias("k"), F.lit("other").alias("search_type"))))
        .when(kind == 6, F.to_json(F.struct(text.alias("query"), F.lit("7").alias("k"))))
        .otherwise(F.concat(F.lit("nope "), text))
    )
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), body.alias("body"))


def _write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            filesystem, inner = open_filesystem(path)
            filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with filesystem.open_output_stream(inner) as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])


def write_files(rows: DataFrame) -> int:
    """Write (path, content) rows as files from the tasks; rerunning is safe."""
    written = rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_write_files, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def corpus_rows(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Every document as a file to write below ``root``, kinds of names mixed."""
    number = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("d"), number, F.lit(".md")))
        .when(kind == 1, F.concat(F.lit("_d"), number, F.lit(".py")))
        .when(kind == 2, F.concat(F.lit(".d"), number, F.lit(".txt")))
        .when(kind == 3, F.concat(F.lit(".d"), number))
        .when(kind == 4, F.concat(F.lit("d"), number, F.lit(".LOG")))
        .otherwise(F.concat(F.lit("d"), number))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", F.lit(root), "source", name).alias("path"), F.col("text").alias("content")
    )


def corpus_folder(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "corpus")
    write_files(corpus_rows(spark, sf_dir, root))
    return root


def customer_tables(spark: SparkSession, sf_dir: str) -> str:
    """The customers as comma-separated files of 500 keys each."""
    root = scratch_path(spark, "tables")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.expr("c_custkey div 500").alias("block")
    )
    rows.repartition("block").sortWithinPartitions("block", "c_custkey").write.partitionBy("block").csv(root, header=True)
    return root
