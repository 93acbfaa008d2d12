"""A training corpus from documents, stage by stage.

Every stage needs doc_id and text, keeps all other columns as they are, and
takes an empty table to an empty one. A null text is an empty one; a null
doc_id is no id, and rows that share an id, or have none, are told apart by
their texts. Rows that repeat id and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import table
from passagemill.llm.decontaminate import drop_leaks
from passagemill.llm.linededup import dedup_lines
from passagemill.llm.packing import pack
from passagemill.llm.quality import keep_good
from passagemill.llm.simhash import drop_near_duplicates
from passagemill.session import keep, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts have a score, too."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; a text that loses all its lines goes whole.

    Null and empty texts stay. ``n_chars``, where there is such a column, counts what is left.
    """
    done = dedup_lines(docs).where("n_removed = 0 OR text <> ''")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that SimHash links, the one with the smallest doc_id stays; of texts without words, too."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its own or other parameters, go; null and empty texts hold none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is tokenised, cut and packed into sequences; an empty text is its end id alone. Only doc_id and text are read."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("best-fit packing", packing),
]

# The classifier and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
