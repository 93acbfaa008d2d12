"""Change detection against the manifest of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per path: new, changed, unchanged, or missing from the folder."""
    now = files.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("on_disk"))
    before = manifest.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("on_disk").isNull(), "missing")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("changed")
    )
    return now.join(before, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")


def merge_manifest(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """Upsert by path; entries of paths not processed stay as they are."""
    kept = manifest.join(processed.select("path"), "path", "left_anti")
    columns = ["path", "hash", "processed_at", "size"]
    return kept.select(*columns).unionByName(processed.select(*columns))


def drop_missing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Opt-in clean-up: keep entries whose file still exists."""
    return manifest.join(files.select("path"), "path", "left_semi")


def replace_chunks(store: DataFrame, new_chunks: DataFrame, changed_paths: DataFrame | None = None) -> DataFrame:
    """Drop the chunks of every changed path, then add the new ones.

    A changed file may now yield no chunk, so ``changed_paths`` can be given;
    by default it is the paths of ``new_chunks``.
    """
    changed = (new_chunks if changed_paths is None else changed_paths).select("path")
    return store.join(changed, "path", "left_anti").unionByName(new_chunks)


def ingest_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents loaded and chunks created."""
    parts = documents.select(F.lit("d").alias("part")).unionAll(chunks.select(F.lit("c").alias("part")))
    return parts.agg(
        F.count_if(F.col("part") == "d").alias("documents_loaded"),
        F.count_if(F.col("part") == "c").alias("chunks_created"),
    )
