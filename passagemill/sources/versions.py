"""Numbered Parquet versions below a folder.

A version is written to a folder of its own and becomes ``v<number>`` by one
rename that fails where that number exists already. So a run that dies leaves
the previous version current, nothing is overwritten while it is being read,
and of two writers that start from the same version one gets a
``VersionConflict`` and must look again.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from passagemill.session import child_names, delete_path, path_exists


class VersionConflict(RuntimeError):
    """Another writer has added the version that this one was about to add."""


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[1:]) for name in child_names(spark, path) if name.startswith("v") and name[1:].isdigit())


def current_number(spark: SparkSession, path: str) -> int | None:
    """The newest complete version."""
    complete = (n for n in reversed(version_numbers(spark, path)) if path_exists(spark, f"{path}/v{n}/_SUCCESS"))
    return next(complete, None)


def current_version(spark: SparkSession, path: str) -> str | None:
    number = current_number(spark, path)
    return None if number is None else f"{path}/v{number}"


def newest_number(spark: SparkSession, path: str) -> int:
    """The number that the next version follows; 0 before the first."""
    return max(version_numbers(spark, path), default=0)


def _rename_once(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; fails if the target exists, also where two try at once."""
    jvm = spark._jvm
    to_uri = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to_uri(source).toUri(), spark._jsc.hadoopConfiguration())
    none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    files.rename(to_uri(source), to_uri(target), options)


def write_version(rows: DataFrame, path: str, keep: int = 3, base: int | None = None) -> str:
    """Write the version after ``base`` (by default after the newest) and drop
    all but the last ``keep``."""
    spark = rows.sparkSession
    numbers = version_numbers(spark, path)
    number = (max(numbers, default=0) if base is None else base) + 1
    if number in numbers:
        raise VersionConflict(f"{path}: version {number} exists already")
    staged, target = f"{path}/.new-{uuid.uuid4().hex}", f"{path}/v{number}"
    rows.write.parquet(staged)
    try:
        _rename_once(spark, staged, target)
    except Py4JJavaError as error:
        delete_path(spark, staged)
        if path_exists(spark, target):
            raise VersionConflict(f"{path}: version {number} exists already") from error
        raise
    numbers = [n for n in numbers if n < number]
    for old in numbers[: max(0, len(numbers) + 1 - keep)]:
        delete_path(spark, f"{path}/v{old}")
    return target
