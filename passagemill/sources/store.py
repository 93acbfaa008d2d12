"""The vector table: chunks with their embedding, as Parquet.

Each write adds one folder below ``data``, laid out in ``bucket`` folders by a
hash of the chunk's path. A small versioned ``parts`` table names the folders
that make up the store, in the order of their writes. A write that replaces
the chunks of changed files adds, beside its own chunks, a list of the paths
that it supersedes; readers leave out what an older write holds for them. So
a write costs what has changed, not what is stored, and readers see all of it
or none. ``compact_store`` brings a store back to one folder without lists.

Writers may overlap: a version of the parts follows the one it was made from,
and a writer that finds another version in between adds its folders to that.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.schemas import STORE
from passagemill.session import child_names, delete_path
from passagemill.sources.versions import VersionConflict, current_number, newest_number, write_version

log = logging.getLogger(__name__)

# A bucket is what a reader of some paths has to look through, so aim for a few
# gigabytes each; the number is fixed when the store is created or compacted.
BUCKETS = 8
BUCKET_BYTES = 4 * 1024**3
MOST_BUCKETS = 8192
PARTS = "folder string, bucket int, buckets int, place long, gone boolean"
#: Times a writer looks again when others come first.
ATTEMPTS = 20
Parts = list[tuple[str, int, int, int, bool]]


def as_store(chunks: DataFrame) -> DataFrame:
    """Exactly the store's columns; metadata that is absent becomes null."""
    present = set(chunks.columns)
    return chunks.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE.fields
    ])


def bucket_count(text_bytes: int) -> int:
    """Buckets for a store of documents of that total size."""
    return min(MOST_BUCKETS, max(BUCKETS, -(-text_bytes // BUCKET_BYTES)))


def bucket_of(path: str, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _read_parts(spark: SparkSession, path: str) -> Parts:
    """(folder, bucket, buckets, place, gone) rows: buckets times writes since the
    last compaction, so few. ``gone``: the write has a list of superseded paths."""
    number = current_number(spark, f"{path}/parts")
    if number is None:
        return []
    return [tuple(row) for row in spark.read.schema(PARTS).parquet(f"{path}/parts/v{number}").collect()]


def _write_parts(spark: SparkSession, path: str, parts: Parts, base: int) -> None:
    write_version(spark.createDataFrame(parts, PARTS).coalesce(1), f"{path}/parts", base=base)


def _add_part(spark: SparkSession, path: str, added: list[tuple[str, int, int]], gone: bool) -> None:
    """Make a written folder the newest part of the store."""
    for _ in range(ATTEMPTS):
        base = newest_number(spark, f"{path}/parts")
        parts = _read_parts(spark, path)
        place = max(part[3] for part in parts) + 1
        try:
            return _write_parts(spark, path, parts + [(*part, place, gone) for part in added], base)
        except VersionConflict:
            log.info("another writer was first at %s; looking again", path)
    raise VersionConflict(f"{path}: others came first {ATTEMPTS} times")


def _write_data(chunks: DataFrame, path: str, buckets: int, folder: str | None = None) -> list[tuple[str, int, int]]:
    """Write one data folder and return its parts."""
    spark = chunks.sparkSession
    folder = folder or f"w{uuid.uuid4().hex}"
    rows = as_store(chunks).withColumn("bucket", bucket_of("path", buckets))
    if buckets > 1:
        # Rebalancing groups rows by bucket for few output files, and lets
        # adaptive execution split a bucket that is too large for one task.
        # A store of one bucket is written where its rows are.
        rows = rows.hint("rebalance", "bucket")
    rows.write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    names = [name for name in child_names(spark, f"{path}/data/{folder}") if name.startswith("bucket=")]
    return [(folder, int(name.split("=")[1]), buckets) for name in names]


def _place_of(kind: str, places: dict[str, int]) -> Column:
    """The place, in the order of writes, of the folder that a row's file is in."""
    known = F.create_map(*[F.lit(x) for folder, place in places.items() for x in (folder, place)])
    return F.element_at(known, F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}/(w[0-9a-f]+)/", 1))


def _read_data(spark: SparkSession, path: str, parts: Parts) -> DataFrame:
    """What the parts hold, without what later ones supersede."""
    held = [part for part in parts if part[1] >= 0]
    if not held:
        return spark.createDataFrame([], STORE)
    rows = spark.read.schema(STORE).parquet(*[f"{path}/data/{folder}/bucket={bucket}" for folder, bucket, *_ in held])
    oldest = min(part[3] for part in held)
    lists = {part[0]: part[3] for part in parts if part[4] and part[3] > oldest}
    if not lists:
        return rows
    rows = rows.select("*", _place_of("data", {part[0]: part[3] for part in held}).alias("__place"))
    # Lists are as many as writes since the last compaction, and one scan. Spark broadcasts it while it is small.
    gone = spark.read.schema("path string").parquet(*[f"{path}/gone/{name}" for name in lists])
    gone = gone.groupBy("path").agg(F.max(_place_of("gone", lists)).alias("__until"))
    rows = rows.join(gone, "path", "left").where("__until IS NULL OR __place >= __until")
    return rows.select(*STORE.names)


def store_exists(spark: SparkSession, path: str) -> bool:
    return current_number(spark, f"{path}/parts") is not None


def create_store(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """First write; an earlier store at ``path`` is replaced as a whole."""
    spark = chunks.sparkSession
    base = newest_number(spark, f"{path}/parts")
    parts = _write_data(chunks, path, buckets)
    # An empty store still records its bucket count.
    _write_parts(spark, path, [(*part, 0, False) for part in parts or [("", -1, buckets)]], base)


def append_store(chunks: DataFrame, path: str) -> None:
    """Add chunks to an existing store, leaving older ones as they are."""
    spark = chunks.sparkSession
    parts = _read_parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no store at {path}")
    _add_part(spark, path, _write_data(chunks, path, parts[0][2]), False)


def load_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store as it is now, or None with a warning when there is none."""
    parts = _read_parts(spark, path)
    if not parts:
        log.warning("no store at %s", path)
        return None
    return _read_data(spark, path, parts)


def reload_store(spark: SparkSession, path: str) -> DataFrame | None:
    """Open the store again, seeing what other writers added since."""
    return load_store(spark, path)


def load_paths(spark: SparkSession, path: str, paths: DataFrame) -> DataFrame:
    """What the store holds of some paths, from their buckets alone."""
    parts = _read_parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no store at {path}")
    # At most ``buckets`` numbers for each bucket count that writes have used.
    wanted = {
        buckets: {row[0] for row in paths.select(bucket_of("path", buckets)).distinct().collect()} for buckets in {part[2] for part in parts}}
    kept = [part if part[1] in wanted[part[2]] else (part[0], -1, *part[2:]) for part in parts]
    return _read_data(spark, path, kept).join(paths.select("path").distinct(), "path", "left_semi")


def update_store(new_chunks: DataFrame, path: str, changed_paths: DataFrame | None = None) -> None:
    """Replace the chunks of changed paths.

    ``changed_paths`` names paths that may have no chunk left; by default the
    paths of ``new_chunks``. Running it again gives the same rows. Nothing of
    what the store holds is read or rewritten.
    """
    spark = new_chunks.sparkSession
    parts = _read_parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no store at {path}")
    buckets = parts[0][2]
    folder = f"w{uuid.uuid4().hex}"
    written = _write_data(new_chunks, path, buckets, folder)
    if changed_paths is None:
        fresh = [f"{path}/data/{name}/bucket={bucket}" for name, bucket, _ in written]
        changed_paths = spark.read.schema(STORE).parquet(*fresh) if fresh else None
    if changed_paths is None:
        return
    changed_paths.select("path").distinct().write.parquet(f"{path}/gone/{folder}")
    # A write without chunks is a part for its list alone.
    _add_part(spark, path, written or [(folder, -1, buckets)], True)


def compact_store(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Rewrite the store as one folder without superseded rows.

    Call it when many writes have gathered. Writers may go on meanwhile: the
    new folder takes the place of those that were read, and what came later
    stays after it. A second compaction, or a store that has been replaced in
    between, makes it fail with a ``VersionConflict``, and nothing is lost.
    """
    parts = _read_parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no store at {path}")
    buckets = buckets or parts[0][2]
    place = max(part[3] for part in parts)
    written = _write_data(_read_data(spark, path, parts), path, buckets)
    compacted = [(*part, place, False) for part in written or [("", -1, buckets)]]
    for _ in range(ATTEMPTS):
        base = newest_number(spark, f"{path}/parts")
        now = _read_parts(spark, path)
        if not set(parts) <= set(now):
            break
        try:
            return _write_parts(spark, path, compacted + [part for part in now if part not in parts], base)
        except VersionConflict:
            log.info("another writer was first at %s; looking again", path)
    raise VersionConflict(f"{path}: the store was replaced meanwhile, or others came first {ATTEMPTS} times")


def vacuum_store(spark: SparkSession, path: str) -> list[str]:
    """Delete data folders the current version does not use; readers of an
    older version, and writers, must be done."""
    used = {part[0] for part in _read_parts(spark, path)}
    unused = [name for name in child_names(spark, f"{path}/data") if name not in used]
    for kind in ("data", "gone"):
        for name in child_names(spark, f"{path}/{kind}"):
            if name not in used:
                delete_path(spark, f"{path}/{kind}/{name}")
    return unused
