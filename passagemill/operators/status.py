"""Small reports about a store and its surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import path_exists
from passagemill.sources.manifest import manifest_exists
from passagemill.sources.store import load_store, store_exists


def store_info(store: DataFrame, by_type: bool = False) -> DataFrame:
    """Vectors, documents and dimension, in total or per file type."""
    grouped = store.groupBy("file_type") if by_type else store.groupBy()
    return grouped.agg(
        F.count("embedding").alias("vectors"),
        F.count_distinct("path").alias("documents"),
        F.max(F.size("embedding")).alias("dimension"),
    )


def store_status(spark: SparkSession, store: str, manifest: str, root: str) -> DataFrame:
    """One row telling which parts of a set-up are in place."""
    loaded = store_exists(spark, store) and load_store(spark, store) is not None
    row = (
        store_exists(spark, store), loaded, store, manifest_exists(spark, manifest), manifest,
        path_exists(spark, root), root,
    )
    return spark.createDataFrame(
        [row],
        "store_exists boolean, store_loaded boolean, store_path string, manifest_exists boolean, "
        "manifest_path string, folder_exists boolean, folder_path string",
    )
