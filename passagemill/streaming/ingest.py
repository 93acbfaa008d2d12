"""Documents arriving as a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from passagemill.operators.embedding import embed_hash
from passagemill.plans.ingest import Embedder, chunks_with_vectors
from passagemill.session import keep, path_exists, scratch
from passagemill.settings import Settings
from passagemill.sources.store import BUCKETS, create_store, load_store, store_exists, update_store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_per_path(documents: DataFrame) -> DataFrame:
    """One version per path: the one processed last."""
    newest = F.max_by(F.struct(*documents.columns), F.struct("processed_at", F.md5(F.col("content").cast("binary"))))
    return documents.groupBy("path").agg(newest.alias("d")).select("d.*")


#: Paths are dealt into this many states: a batch looks at a state once for all its paths there.
STATE_BUCKETS = 1024


class NewestVersion(StatefulProcessor):
    """Lets each path's newest version of a batch through, unless a later one came before.

    The state of a bucket of paths is the time of the version let through last
    of each, in microseconds; a version without a time is always let through
    and clears its path's. A call to the state takes milliseconds however
    little it holds, so paths do not have states of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "times string")

    def _times(self) -> dict[str | None, int]:
        held = self.newest.get()
        return {} if held is None else {path: at for path, at in json.loads(held[0])}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        places, pieces = {}, []
        for frame in rows:
            chosen = {}
            for n, (path, at, content) in enumerate(zip(frame["path"], frame["processed_micros"], frame["content"])):
                digest = "" if content is None else hashlib.md5(content.encode(), usedforsecurity=False).hexdigest()
                own = (not pd.isna(at), 0 if pd.isna(at) else int(at), digest)
                if path not in places or own > places[path]:
                    chosen[path], places[path] = n, own
            pieces.append((list(chosen), frame.iloc[list(chosen.values())]))
        times = self._times()
        before, late = dict(times), set()
        for path, (timed, at, _) in places.items():
            if timed and times.get(path, at) > at:
                late.add(path)
            elif timed:
                times[path] = at
            else:
                times.pop(path, None)
        if times != before:
            self.newest.update((json.dumps(list(times.items())),))
        # The best of a path is in the last piece that has it.
        fresh, seen = [], late
        for paths, piece in reversed(pieces):
            fresh.append(piece.iloc[[n for n, path in enumerate(paths) if path not in seen]])
            seen.update(paths)
        fresh = [piece for piece in fresh if len(piece)]
        if fresh:
            yield pd.concat(fresh, ignore_index=True).drop(columns=["processed_micros", "bucket"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        times = self._times()
        times.update((path, int(at)) for path, at in zip(initialState["path"], initialState["at"]) if not pd.isna(at))
        if times:
            self.newest.update((json.dumps(list(times.items())),))

    def close(self) -> None:
        pass


def _bucket() -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(STATE_BUCKETS)).alias("bucket")


def _held(spark: SparkSession, store: str) -> DataFrame:
    """The time of each path that a store holds."""
    held = load_store(spark, store).groupBy("path").agg(F.max(F.unix_micros("processed_at")).alias("at"))
    return held.select(_bucket(), "path", "at")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def newest_versions(documents: DataFrame, store: str, checkpoint: str) -> DataFrame:
    """Of a stream of documents those that are newer than what came before, by keyed state.

    A store that is there when the stream first begins is the initial state;
    later batches look at the states of their own paths' buckets alone.
    """
    spark = documents.sparkSession
    begun = path_exists(spark, f"{checkpoint}/commits")
    held = _held(spark, store).groupBy("bucket") if not begun and store_exists(spark, store) else None
    timed = documents.select("*", F.unix_micros(F.col("processed_at").cast("timestamp")).alias("processed_micros"), _bucket())
    return timed.groupBy("bucket").transformWithStateInPandas(
        NewestVersion(), outputStructType=documents.schema, outputMode="Update", timeMode="None", initialState=held)


def ingest_stream(
    documents: DataFrame, store: str, checkpoint: str, embedder: Embedder = embed_hash,
    settings: Settings = Settings(), available_now: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of document rows.

    Each micro-batch replaces the chunks of its paths, so replaying a batch
    after a failure leaves the same rows, not a second copy. The newest time of
    each path is the stream's state, kept by bucket of paths in RocksDB and
    checkpointed, so a batch reads nothing of the store and its cost follows the
    batch and the times kept beside its paths;
    ``compact_store`` now and then keeps reading cheap. A document that was
    processed before what came of its path, or what the store held of it when
    the stream first began, is late and changes nothing. ``buckets`` is for a
    store that does not exist yet.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark, "ingest-stream") as work:
            # Computed once: the state moves on with it.
            fresh = keep(batch, "fresh", f"{work}/fresh")
            chunks = chunks_with_vectors(fresh, embedder, settings)
            if store_exists(spark, store):
                update_store(chunks, store, fresh)
            else:
                create_store(chunks, store, buckets)

    with _set(documents.sparkSession, PROVIDER, ROCKSDB):
        fresh = newest_versions(documents, store, checkpoint)
        writer = fresh.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
