"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Options that change results or plans; cluster sizing stays with the caller.
SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text rows can be large: keep Arrow batches small in bytes, not only rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(app_name: str = "passagemill", master: str | None = None, **options) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_OPTIONS, **options}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent
        # Spark serves the archive from the driver; only the driver reads this file.
        archive = Path(tempfile.mkdtemp(prefix="passagemill-")) / f"passagemill-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w") as target:
            for module in sorted(package.rglob("*.py")):
                target.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)
    return spark


# Below this size a table may be dealt out evenly before heavy per-row work.
SPREAD_BYTES = 1024 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small input out over all tasks; leave a large one as it is.

    A file with a single row group is a single task's work however many cores
    are free. Moving such an input costs little; an input beyond
    ``SPREAD_BYTES`` already has enough splits and must not be shuffled.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = _local_fallback()
    return configured.rstrip("/")


@lru_cache(maxsize=1)
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="passagemill-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/passagemill/{label}-{uuid.uuid4().hex}"


def keep(rows: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write rows to the shared folder once and read them back.

    Cuts the lineage, so rows that are used several times are computed once
    and survive the loss of executors, and tells the optimizer their size.
    (``checkpoint`` would compute them twice.)
    """
    path = path or scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A work folder that is removed again when the block succeeds."""
    path = scratch_path(spark, label)
    yield path
    delete_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the work tables of all runs; no result that reads them may be in use."""
    delete_path(spark, f"{shared_dir(spark)}/passagemill")


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path`` (used for version folders, so few)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(jpath))
