"""What several operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import keep

#: A list of ids up to this many bytes may be sent to all executors.
BROADCAST_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text of a row; a null is an empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: What a broadcast row of a few numbers takes in an executor's table.
BROADCAST_ROW = 64


def free_name(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` does not have."""
    while name in rows.columns:
        name = f"_{name}"
    return name


def split_by_ids(rows: DataFrame, ids: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are among ``ids``, and the others.

    ``ids`` (columns ``keys``, distinct, a written table) is broadcast only if
    it is small, so that the texts of ``rows`` stay where they are; beyond that
    both sides are shuffled. Nulls are equal to each other.
    """
    names = [free_name(rows, f"__other_{n}") for n in range(len(keys))]
    other = ids.select(*(F.col(key).alias(name) for key, name in zip(keys, names)))
    if ids.count() * BROADCAST_ROW * len(keys) <= BROADCAST_BYTES:
        other = F.broadcast(other)
    same = reduce(Column.__and__, (rows[key].eqNullSafe(F.col(name)) for key, name in zip(keys, names)))
    return rows.join(other, same, "left_semi"), rows.join(other, same, "left_anti")


def row_of() -> Column:
    """What tells rows with one doc_id, or none, apart: a hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not among ``gone`` (doc_id, row; distinct, a written table), with all their columns."""
    row = free_name(docs, "__row")
    gone = gone.select("doc_id", F.col("row").alias(row))
    return split_by_ids(docs.withColumn(row, row_of()), gone, "doc_id", row)[1].drop(row)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): a row (u, v) for each vertex u
    with an edge, v being the smallest vertex of its component (v = u left out).

    Rounds of large-star and small-star; each round's edges are a table in the
    shared folder, so a lost executor costs one round at most.
    """
    small = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = small.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0))).first()
        if state[0] == 0 or state == before:
            return small
        before = state
        both = small.unionAll(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = keep(linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
