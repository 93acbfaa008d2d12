"""Substring dedup with prefix-partitioned suffix trees.

The suffixes of all documents (one from each word) are split by their first
words into groups that fit a task's memory: a first word, or a bucket of rare
ones, is a group as long as its suffixes are few; where they are too many, the
prefix is lengthened to all words of a window and dealt into as many groups as
needed, so that no frequent phrase makes a group of its own.
Counts over all documents decide. A group is one subtree. Its leaves are the
suffixes, and an internal node of a depth of ``window`` words or more with
leaves of two documents is a passage that repeats; leaves are sorted by the
hash of their first ``window`` words, so such a node is a run of equal hashes.
Nodes one word further on belong to the subtree of that word; the removed
spans of a document, merged, are its maximal repeats.

Before anything is shuffled, a task merges its own repeats: of a passage that
many of its documents hold, one leaf goes to the subtree, so a passage that a
third of all documents share arrives once for each task's chunk. Leaves travel
packed (8 bytes of hash, and the document's id as a byte-plane difference that
the shuffle's compression takes down to about nothing).

Two different passages are taken as equal only if they agree in a 64-bit hash
and in the words that chose their group.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_BYTES, split_by_ids
from passagemill.session import keep

WINDOW = 13
#: First words are counted in so many buckets; a heavy one is split by its longer prefix.
BUCKET_BITS = 12
#: Leaves of a subtree, words that a map task merges at once, documents of a bucket when texts are cut, and bytes of a part of one.
GROUP_LEAVES = 2_000_000
CHUNK_WORDS = 1_000_000
BUCKET_DOCS = 2_000
PART_BYTES = 32 * 1024 * 1024
#: Stands for a null doc_id, which sorts before all others.
NULL_ID = -(1 << 63)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
KEPT = "doc_id long, kept string, n_words long, n_removed long, removed array<struct<start:long,end:long>>"


class WordHashes(dict):
    """Word to hash, remembered for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (none, if there are fewer)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= FACTOR
        out += words[k:k + n]
    out ^= out >> np.uint64(32)
    out *= FACTOR
    return out


def pack(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """ids ascending; their differences as byte planes, then the hashes."""
    planes = np.diff(ids, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return struct.pack("<q", len(ids)) + planes.tobytes() + hashes.tobytes()


def unpack(blobs) -> tuple[np.ndarray, np.ndarray]:
    """All ids and hashes of packed blobs (which may follow each other in one value)."""
    ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for blob in blobs:
        at = 0
        while at < len(blob):
            n = struct.unpack_from("<q", blob, at)[0]
            planes = np.frombuffer(blob, np.uint8, 8 * n, at + 8).reshape(8, n)
            ids.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()))
            hashes.append(np.frombuffer(blob, np.uint64, n, at + 8 + 8 * n))
            at += 8 + 16 * n
    return np.concatenate(ids), np.concatenate(hashes)


def repeated(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by hash: the order, and whether a smaller id has the same hash."""
    order = np.argsort(hashes, kind="stable")
    ids, hashes = ids[order], hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(ids) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(ids)])) if len(ids) else ids
    return order, ids > least


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            yield NULL_ID if doc_id is None else doc_id, text.as_py() or b""


def _shares(docs: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """Suffixes by first-word bucket, and the number of documents, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, docs = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int64), 0
        for _, text in _texts(batches):
            docs += 1
            words = text.split()
            if len(words) >= window:
                first = hashes.of(words[:len(words) - window + 1])
                counts += np.bincount((first >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], docs])], ["bucket", "n"])

    rows = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    total = 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            counts[bucket] = n
    return counts, total


def _prefix_groups(counts: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each bucket; light buckets share one."""
    base, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, filled = 0, 0
    for bucket in np.argsort(-counts, kind="stable").tolist():
        n = int(counts[bucket])
        if n > leaves:
            parts[bucket] = math.ceil(n / leaves)
            base[bucket] = group
            group += int(parts[bucket])
            continue
        if filled + n > leaves:
            group, filled = group + 1, 0
        base[bucket], filled = group, filled + n
    return base, parts


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)) or n < 2:
        n += 1
    return n


def _by_bucket(ids: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed (id, hash) pairs for each bucket of documents."""
    bucket = np.mod(ids, buckets)
    order = np.lexsort((ids, bucket))
    ids, hashes, bucket = ids[order], hashes[order], bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(ids) else []
    for start, end in zip(edges[:-1], edges[1:]):
        yield int(bucket[start]), pack(ids[start:end], hashes[start:end])


def repeats(docs: DataFrame, window: int = WINDOW, leaves: int = GROUP_LEAVES) -> tuple[DataFrame, int]:
    """Windows that a document with a smaller id also holds: (bucket, packed ids
    and window hashes), and the number of buckets; a bucket's ids are equal
    modulo that number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, documents = _shares(rows, window)
    many = 2 * docs.sparkSession.sparkContext.defaultParallelism
    leaves = max(1, min(leaves, math.ceil(int(counts.sum()) / many)))
    base, parts = _prefix_groups(counts, leaves)
    buckets = _prime_from(max(many, math.ceil(documents / BUCKET_DOCS)))

    def chunk(ids: list[int], words: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
        """(group, leaves for its subtree, windows already found to repeat)."""
        lengths = np.array([len(w) for w in words])
        joined = np.concatenate(words)
        full = rolling(joined, window)
        keep_ = np.arange(len(joined)) <= np.repeat(np.cumsum(lengths) - window, lengths)
        keep_ = keep_[:len(full)]
        bucket = (joined[:len(full)] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[keep_]
        group = base[bucket] + (full[keep_] % parts[bucket].astype(np.uint64)).astype(np.int64)
        owner = np.repeat(np.array(ids, np.int64), lengths)[:len(full)][keep_]
        full = full[keep_]
        order, found = repeated(owner, full)
        owner, full, group = owner[order], full[order], group[order]
        same = np.r_[False, (full[1:] == full[:-1]) & (owner[1:] == owner[:-1])] if len(full) else np.zeros(0, bool)
        for flag, use in ((False, ~found & ~same), (True, found & ~same)):
            o, h, g = owner[use], full[use], group[use]
            order = np.lexsort((o, g))
            o, h, g = o[order], h[order], g[order]
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else []
            for start, end in zip(edges[:-1], edges[1:]):
                blob = pack(o[start:end], h[start:end])
                yield int(g[start]), b"" if flag else blob, blob if flag else b""

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, words, held = WordHashes(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*chunk(ids, words)))
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                    ["grp", "leaves", "found"])

        for doc_id, text in _texts(batches):
            split = text.split()
            if len(split) < window:
                continue
            ids.append(doc_id)
            words.append(hashes.of(split))
            held += len(split)
            if held >= CHUNK_WORDS:
                yield from flush()
                ids, words, held = [], [], 0
        if held:
            yield from flush()

    def subtree(group: pa.Table) -> pa.Table:
        ids, hashes = unpack(x.as_py() for x in group.column("leaves"))
        order, found = repeated(ids, hashes)
        ids, hashes = ids[order][found], hashes[order][found]
        more_ids, more = unpack(x.as_py() for x in group.column("found"))
        out = list(_by_bucket(np.r_[ids, more_ids], np.r_[hashes, more], buckets))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "windows": pa.array([w for _, w in out], pa.binary())})

    found = rows.mapInArrow(leaves_of, "grp int, leaves binary, found binary") \
        .groupBy("grp").applyInArrow(subtree, "bucket long, windows binary")
    return keep(found, "repeats"), buckets


def _cut(text: bytes, hashes: WordHashes, flagged: np.ndarray, window: int) -> tuple[str, int, int, list[dict]]:
    words = text.split()
    bad = np.isin(rolling(hashes.of(words), window), flagged) if len(flagged) else np.zeros(0, bool)
    if not bad.any():
        return b" ".join(words).decode(), len(words), 0, []
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:len(bad)] += bad
    steps[window:window + len(bad)] -= bad
    covered = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    kept = [w for w, c in zip(words, covered.tolist()) if not c]
    return b" ".join(kept).decode(), len(words), int(covered.sum()), spans


def _kept_rows(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    kept, n, removed, spans = zip(*rows) if rows else ((), (), (), ())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([None if x == NULL_ID else x for x in ids], pa.int64()), pa.array(kept, pa.string()), pa.array(n, pa.int64()),
         pa.array(removed, pa.int64()), pa.array(spans, span)], ["doc_id", "kept", "n_words", "n_removed", "removed"])


def dedup_passages(docs: DataFrame, window: int = WINDOW, leaves: int = GROUP_LEAVES) -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space), n_words, n_removed
    and the removed spans of words, for every row of ``docs`` (doc_id, text).

    A word goes if a window of consecutive words that covers it also starts in
    a document with a smaller doc_id; all windows are judged on the input.
    Words are split at ASCII white space. A null text has no words; a text with
    fewer words than a window stays as it is. A null doc_id is smaller than any
    other; rows that share a doc_id do not remove each other's words. Other
    columns are not read. (A table with both the least and the greatest doc_id
    of 64 bits has no number left for a null one and is an error.)
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low == NULL_ID:
        # The least number stands for a null.
        if high == -1 - NULL_ID:
            raise ValueError("doc_id takes up all of 64 bits")
        moved = dedup_passages(rows.withColumn("doc_id", F.col("doc_id") + 1), window, leaves)
        return moved.withColumn("doc_id", F.col("doc_id") - 1)
    found, buckets = repeats(rows, window, leaves)

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.unique(unpack([blob.as_py()])[0]) for blob in batch.column(1)]
            packed = [pack(ids, np.zeros(len(ids), np.uint64)) for ids in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["bucket", "ids"])

    def distinct(bucket: pa.Table) -> pa.Table:
        ids = np.unique(unpack(x.as_py() for x in bucket.column("ids"))[0])
        return pa.table({"doc_id": pa.array([None if x == NULL_ID else x for x in ids.tolist()], pa.int64())})

    ids = found.mapInArrow(owners, "bucket long, ids binary").groupBy("bucket").applyInArrow(distinct, "doc_id long")
    ids = keep(ids, "owners")
    hit, rest = split_by_ids(rows, ids, "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            pairs = list(_texts([batch]))
            yield _kept_rows([x for x, _ in pairs], [_cut(t, hashes, np.zeros(0, np.uint64), window) for _, t in pairs])

    def cut(texts: pa.Table, windows: pa.Table) -> pa.Table:
        hashes = WordHashes()
        owner, flagged = unpack(x.as_py() for x in windows.column("windows"))
        order = np.argsort(owner, kind="stable")
        owner, flagged = owner[order], flagged[order]
        ids, out = [], []
        for doc_id, text in _texts(texts.select(["doc_id", "text"]).to_batches()):
            low, high = (np.searchsorted(owner, doc_id, side) for side in ("left", "right"))
            ids.append(doc_id)
            out.append(_cut(text, hashes, flagged[low:high], window))
        return pa.Table.from_batches([_kept_rows(ids, out)])

    keyed = hit.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(NULL_ID)), F.lit(buckets)).cast("long"))
    # A bucket of many bytes (long texts, or many under one id) is cut in parts by its texts, and each has the bucket's windows.
    parts = keyed.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("text")) / PART_BYTES).cast("int").alias("parts")).where("parts > 1")
    parts = keep(parts, "parts")
    parts = F.broadcast(parts) if parts.count() * 64 <= BROADCAST_BYTES else parts
    many = F.coalesce("parts", F.lit(1))
    keyed = keyed.join(parts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("text"), many).cast("int")).drop("parts")
    dealt = found.join(parts, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), "windows")
    done = keyed.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInArrow(cut, KEPT)
    return done.unionByName(rest.mapInArrow(whole, KEPT))


SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), single AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), suffixes AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS start, count(*) OVER w AS n
  FROM single WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), windows AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY start) AS first FROM suffixes WHERE n = 13
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM windows, range(13) AS r(k) WHERE first < doc_id
), counted AS (
  SELECT s.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY s.pos) FILTER (WHERE c.pos IS NULL), '') AS kept
  FROM single s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY s.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counted USING (doc_id)
"""
