"""Row filters over files, documents and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import paths as P
from passagemill.functions.text import is_nonblank, trim_blanks
from passagemill.settings import MAX_FILE_BYTES


def filter_visible(files: DataFrame) -> DataFrame:
    return files.where(P.is_visible(F.col("file_name")))


def filter_size_cap(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Only files of unknown kind are capped, strictly below ``max_bytes``."""
    return files.where((F.col("kind") != "other") | (F.col("length") < max_bytes))


def filter_nonblank(documents: DataFrame) -> DataFrame:
    return documents.where(is_nonblank(F.col("content")))


def filter_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the manifest's."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def validate_requests(requests: DataFrame, text_col: str = "query") -> DataFrame:
    """Add ``status`` (valid / rejected) and ``reason`` and trim the text.

    A ``problem`` that ``parse_requests`` found is a reason, too.
    """
    text = trim_blanks(F.col(text_col))
    reason = F.when(F.col(text_col).isNull(), F.concat(F.lit("missing "), F.lit(text_col))).when(
        text == "", F.concat(F.lit("empty "), F.lit(text_col))
    )
    if "problem" in requests.columns:
        reason = F.coalesce(reason, F.col("problem"))
    return (
        requests.withColumn("reason", reason)
        .withColumn(text_col, text)
        .withColumn("status", F.when(F.col("reason").isNull(), "valid").otherwise("rejected"))
        .drop("problem")
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    return requests.where("status = 'valid'").drop("status", "reason")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return requests.where("status = 'rejected'")
