"""The manifest of processed files, one small row per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.schemas import MANIFEST
from passagemill.sources.versions import current_version, write_version


def manifest_exists(spark: SparkSession, path: str) -> bool:
    return current_version(spark, path) is not None


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version; empty when there is none.

    Damaged files raise: an empty manifest would silently redo everything.
    """
    current = current_version(spark, path)
    if current is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(current)


def write_manifest(manifest: DataFrame, path: str, base: int | None = None) -> str:
    """The next version; with ``base``, only if that is still the newest one."""
    return write_version(manifest.select(*MANIFEST.names), path, base=base)
