"""Files below a folder as rows, read by the executors.

Spark's own file sources silently leave out names starting with ``_`` or
``.`` and empty files, all of which a document folder may hold, so the tree is
walked here instead: one Spark pass per directory level, each directory listed
by a task, nothing but the level count on the driver. The folder must be on
storage every executor reaches (a shared mount, or an object store or HDFS
that pyarrow can open).
"""

from __future__ import annotations

import hashlib
import logging
import math
import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import paths as P
from passagemill.functions.text import content_hash, decode_bytes
from passagemill.operators.userfuncs import image_to_text
from passagemill.schemas import FILES
from passagemill.session import scratch_path
from passagemill.settings import ENCODINGS

log = logging.getLogger(__name__)

LISTING = "path string, length long, is_dir boolean"
TEXTS = "path string, length long, kind string, hash string, text string"
HASHES = "path string, length long, hash string"
LISTING_ROWS = 10_000
READ_BLOCK = 8 * 1024 * 1024
# What one value of a row can hold; a longer file is an unreadable one, and the run goes on.
MOST_BYTES = (1 << 31) - (1 << 20)
# Files that a task holds at once; as bytes, as text and on their way to Spark they take several times that.
BATCH_BYTES = 8 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path inside it."""
    if "://" in path and not path.startswith("file:"):
        scheme, rest = path.split("://", 1)
        authority, _, inner = rest.partition("/")
        scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        filesystem, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
        return filesystem, f"{base.rstrip('/')}/{inner}"
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.LocalFileSystem(), path


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, size, is_dir) of files and folders directly in ``folder``.

    A local folder is read as a stream, however many entries it has; links to
    folders are not followed.
    """
    filesystem, inner = open_filesystem(folder)
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(inner) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, 0, True
                elif entry.is_file():
                    try:
                        size = entry.stat().st_size
                    except OSError as error:  # deleted meanwhile, or closed to us
                        log.warning("could not look at %s/%s: %s", folder, entry.name, error)
                        continue
                    yield entry.name, size, False
        return
    for info in filesystem.get_file_info(pafs.FileSelector(inner)):
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield info.base_name, info.size or 0, info.type == pafs.FileType.Directory


def _readable(folder: str) -> Iterator[tuple[str, int, bool]]:
    """Entries of a folder as far as they can be read; the rest is logged."""
    entries = _entries(folder)
    while True:
        try:
            yield next(entries)
        except StopIteration:
            return
        except OSError as error:
            log.warning("could not list %s: %s", folder, error)
            return


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            entries = _readable(folder)
            while rows := list(islice(entries, LISTING_ROWS)):
                names, sizes, dirs = zip(*rows)
                paths = [f"{folder.rstrip('/')}/{name}" for name in names]
                yield pd.DataFrame({"path": paths, "length": sizes, "is_dir": dirs})


def list_files(spark: SparkSession, root: str, listing: str | None = None) -> DataFrame:
    """Every regular file under ``root`` as (path, length).

    The listing is kept in the ``listing`` folder, by default a new one in the
    shared folder.
    """
    if ":" not in root:
        # Tasks do not share the driver's working directory.
        root = os.path.abspath(root)
    filesystem, inner = open_filesystem(root)
    empty = spark.createDataFrame([], "path string, length long")
    if filesystem.get_file_info(inner).type != pafs.FileType.Directory:
        log.error("folder %s does not exist", root)
        return empty
    listing = listing or scratch_path(spark, "listing")
    frontier = spark.createDataFrame([(root,)], "path string")
    level = 0
    while True:
        target = f"{listing}/level={level}"
        frontier.mapInPandas(_list_directories, LISTING).write.parquet(target)
        found = spark.read.schema(LISTING).parquet(target)
        # An explicit count keeps adaptive execution from merging the listing
        # tasks of many (tiny) path rows into one.
        directories = found.where("is_dir").select("path")
        if directories.isEmpty():
            break
        frontier = directories.repartition(spark.sparkContext.defaultParallelism, "path")
        level += 1
    levels = [f"{listing}/level={n}" for n in range(level + 1)]
    return spark.read.schema(LISTING).parquet(*levels).where("not is_dir").select("path", "length")


def _spread(paths: DataFrame) -> DataFrame:
    """Distribute paths so that each task reads about ``TASK_BYTES``."""
    total = paths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    return paths.repartition(tasks, "path")


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(rows):
        return pd.DataFrame(rows, columns=["path", "length", "content"])

    for batch in batches:
        rows, held = [], 0
        for path, length in zip(batch["path"], batch["length"]):
            try:
                filesystem, inner = open_filesystem(path)
                if (filesystem.get_file_info(inner).size or 0) > MOST_BYTES:
                    raise OSError("too long for one value of a row")
                with filesystem.open_input_stream(inner) as stream:
                    content = stream.read()
                length = len(content)
            except (OSError, MemoryError) as error:
                log.warning("could not read %s: %s", path, error)
                content = None
            rows.append((path, length, content))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield flush(rows)
                rows, held = [], 0
        yield flush(rows)


def _hash_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = []
        for path in batch["path"]:
            digest = hashlib.md5(usedforsecurity=False)
            try:
                filesystem, inner = open_filesystem(path)
                with filesystem.open_input_stream(inner) as stream:
                    while block := stream.read(READ_BLOCK):
                        digest.update(block)
                hashes.append(digest.hexdigest())
            except OSError as error:
                log.warning("could not hash %s: %s", path, error)
                hashes.append("")
        yield batch[["path", "length"]].assign(hash=hashes)


def read_bytes(paths: DataFrame) -> DataFrame:
    """(path, length) -> (path, length, content); unreadable content is null."""
    return _spread(paths.select("path", "length")).mapInPandas(_read_contents, FILES)


def hash_files(paths: DataFrame) -> DataFrame:
    """(path, length) -> (path, length, hash) without moving the bytes."""
    return _spread(paths.select("path", "length")).mapInPandas(_hash_contents, HASHES)


def _read_texts(image_text: Callable[[bytes], str] | None, encodings: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: dict[str, str] = {}

        def paths() -> Iterator[pd.DataFrame]:
            for batch in batches:
                kinds.update(zip(batch["path"], batch["kind"]))
                yield batch

        for files in _read_contents(paths()):
            rows = []
            for path, length, raw in files.itertuples(index=False):
                kind = kinds.pop(path)
                if raw is None:
                    digest, text = "", ""
                else:
                    digest = hashlib.md5(raw, usedforsecurity=False).hexdigest()
                    if kind == "image":
                        text = image_to_text(raw, image_text)
                    else:
                        text = decode_bytes(raw, encodings).replace("\r\n", "\n").replace("\r", "\n")
                rows.append((path, length, kind, digest, text))
            yield pd.DataFrame(rows, columns=["path", "length", "kind", "hash", "text"])

    return run


def read_texts(
    paths: DataFrame, image_text: Callable[[bytes], str] | None = None, encodings: tuple[str, ...] = ENCODINGS,
) -> DataFrame:
    """(path, length, kind) -> the same with ``hash`` and ``text``.

    The task that reads a file also decodes it, so bytes make no round trip.
    Unreadable files hash to the empty string and have no text; images are
    read only when there is a function for them.
    """
    wanted = paths if image_text is not None else paths.where("kind <> 'image'")
    return _spread(wanted.select("path", "length", "kind")).mapInPandas(_read_texts(image_text, encodings), TEXTS)


def scan_files(spark: SparkSession, root: str, mode: str = "complete") -> DataFrame:
    """Every regular file under ``root`` with its bytes and hash.

    ``mode="fast"`` uses Spark's ``binaryFile`` source, which leaves out names
    starting with ``_`` or ``.`` and empty files.
    """
    if mode == "fast":
        found = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", "length", "content")
        )
    elif mode == "complete":
        found = read_bytes(list_files(spark, root))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return found.withColumn("hash", content_hash(F.col("content")))


def with_file_names(files: DataFrame) -> DataFrame:
    """Add file_name and file_type."""
    return files.withColumn("file_name", P.file_name(F.col("path"))).withColumn("file_type", P.file_ext(F.col("file_name")))


def with_file_columns(files: DataFrame, settings) -> DataFrame:
    """Add file_name, file_type and kind."""
    return with_file_names(files).withColumn("kind", P.classify_kind(F.col("file_name"), F.col("file_type"), settings))
