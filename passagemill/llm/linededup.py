"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed; a window that occurs more than
once stays where it occurs first (smallest doc_id, then position) and is
removed elsewhere: the positions that removed windows cover are merged, and
the lines between them are what stays.

Windows are judged on the input. Lines are what newlines separate, compared as
they stand; a document of fewer than three lines has no window and stays.
Only hashes and positions are shuffled. The first occurrence is a minimum,
combined before the shuffle, and a window that very many documents share is
spread over tasks by the join's skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import split_by_ids, table
from passagemill.session import keep

WINDOW_LINES = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """id (doc_id and text hash), position and 128-bit hash of every window."""
    lines = F.split("text", "\n", -1)
    hashed = docs.where(F.size(lines) >= width).select(
        _id().alias("id"), F.transform(lines, lambda x: F.struct(F.xxhash64(x), F.xxhash64(F.lit("line"), x))).alias("h"))
    last = F.size("h") - (width - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda n: F.struct(
        *[f(F.slice("h", n, width)).alias(a) for a, f in (("a", F.xxhash64), ("b", lambda s: F.xxhash64(F.lit("window"), s)))]))
    return hashed.select("id", F.posexplode(windows).alias("at", "w")).select("id", "at", "w.a", "w.b")


def _id() -> Column:
    """Rows that share doc_id and text are judged alike, and others apart."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def dedup_lines(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """``docs`` (doc_id, text, any others) with text deduplicated, and n_lines, n_removed.

    Columns named n_lines or n_removed are replaced; names that begin with two
    underscores are this function's own. A null text stays null with zero lines; an empty text is one empty line. A
    text all of whose lines go becomes empty. A null doc_id sorts before all
    others. Rows that repeat both doc_id and text are one occurrence.
    """
    windows = _windows(docs, width)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last"))
    first = first.where("first <> last").select("a", "b", "first")
    later = windows.join(first, ["a", "b"]).where(F.struct("id", "at") > F.col("first"))
    starts = keep(later.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("starts")), "starts")
    docs = docs.withColumn("__key", F.xxhash64(_id()))
    hit, rest = split_by_ids(docs, keep(starts.select(F.xxhash64("id").alias("__key")).distinct(), "touched"), "__key")
    starts = starts.select(F.xxhash64("id").alias("__other"), F.col("starts").alias("__starts"), F.col("id").alias("__who"))
    hit = hit.join(starts, (F.col("__key") == F.col("__other")) & _id().eqNullSafe(F.col("__who")), "left")
    # Between a removed window's end and the next one's start lie the lines that stay.
    n = F.size(F.split("text", "\n", -1))
    gaps = F.zip_with(F.concat(F.array(F.lit(-width)), F.col("__starts")), F.concat(F.col("__starts"), F.array(n)),
                      lambda a, b: F.struct((a + width).alias("from"), (b - a - width).alias("many")))
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["many"] > 0), lambda g: F.slice("__lines", g["from"] + 1, g["many"])))
    hit = hit.withColumn("__lines", F.split("text", "\n", -1)) \
        .withColumn("__kept", F.when(F.col("__starts").isNull(), F.col("__lines")).otherwise(kept))
    hit = hit.withColumns({
        "text": F.array_join("__kept", "\n"), "n_lines": F.size("__lines").cast("long"),
        "n_removed": (F.size("__lines") - F.size("__kept")).cast("long")}).drop("__lines", "__kept", "__starts", "__who", "__other")
    rest = rest.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), "n_removed": F.lit(0).cast("long")})
    return hit.unionByName(rest).drop("__key")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Kept text of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")) \
        .select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), removed AS (
  SELECT doc_id, pos FROM windows WHERE third IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, pos) > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM removed, (VALUES (0), (1), (2)) AS s(k)
), counted AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
