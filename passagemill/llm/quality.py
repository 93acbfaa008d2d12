"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word slot (words hashed to a fixed number of slots) has a sparse ternary
index vector. A slot's word vector is the sum of the index vectors of the
words around it, over all documents: tasks sum their part, and parts are added
up in a tree. A document is pooled from its words' vectors (mean, spread, and
how alike neighbouring words are). A network of two layers in numpy is trained
on a bounded sample of labelled documents, and a temperature, fitted on
labelled documents that were held back from it, calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import row_of, table, without_rows
from passagemill.session import keep

SLOTS = 1 << 14
DIMENSIONS = 64
NONZERO = 4
REACH = 2
#: Slots of one block of word vectors, and blocks that one task adds up.
BLOCK = 256
FAN_IN = 64
#: Labelled documents that the network is fitted on, at most.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 2e-3, 1e-4
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")
POOLED = 2 * DIMENSIONS + 4


class Slots(dict):
    """Word to slot, remembered for the words of late. Words in capitals are their own."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        folded = word if len(word) > 1 and word.isupper() else word.lower()
        value = self[word] = xxhash.xxh64_intdigest(folded) % SLOTS
        return value

    def of(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's nonzero elements; the last slot has none."""
    rng = np.random.default_rng(seed)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (SLOTS + 1, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (SLOTS + 1, NONZERO))
    signs[SLOTS] = 0
    return places, signs


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[str]:
    for batch in batches:
        for text in batch.column(column):
            yield text.as_py() or ""


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The slots' vectors, summed over all of ``docs`` (text) and scaled to unit length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, (places, signs) = Slots(), index_vectors()
        total = np.zeros((SLOTS + 1) * DIMENSIONS)

        def add(parts: list[np.ndarray]) -> None:
            words = np.concatenate(parts)
            for k in range(1, REACH + 1):
                for a, b in ((words[:-k], words[k:]), (words[k:], words[:-k])):
                    for n in range(NONZERO):
                        np.add(total, np.bincount(a * DIMENSIONS + places[b, n], signs[b, n], len(total)), out=total)

        edge, parts, held = np.full(REACH, SLOTS), [], 0
        for text in _texts(batches, 0):
            words = slots.of(text)
            parts += [words, edge]
            held += len(words)
            if held > 500_000:
                add(parts)
                parts, held = [], 0
        if parts:
            add(parts)
        blocks = total[:SLOTS * DIMENSIONS].reshape(SLOTS // BLOCK, -1).astype(np.int64)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[n].tobytes() for n in some], pa.binary())], ["block", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * DIMENSIONS, np.int64)
        for part in group.column("sums"):
            total += np.frombuffer(part.as_py(), np.int64)
        return pa.table({"block": group.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(partial, "block long, sums binary").withColumn("part", F.spark_partition_id())
    sums = keep(sums, "sums")
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = sums.groupBy("block", "part").applyInArrow(lambda key, t: merge(t).append_column("part", pa.array([key[1].as_py()], pa.int32())),
                                                            "block long, sums binary, part int")
        sums = keep(merged, "sums")
    vectors = np.zeros((SLOTS // BLOCK, BLOCK * DIMENSIONS), np.float32)
    for row in sums.select("block", "sums").toLocalIterator():  # at most SLOTS / BLOCK rows
        vectors[row[0]] = np.frombuffer(bytes(row[1]), np.int64)
    vectors = vectors.reshape(SLOTS, DIMENSIONS)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def pool(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's features; all zero if it has no word."""
    out = np.zeros(POOLED, np.float32)
    n = len(slots)
    if not n:
        return out
    total, squares, alike, alike2 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(2), 0.0
    for at in range(0, n, 50_000):
        x = vectors[slots[at:at + 50_001]]
        own = x[:50_000]
        total += own.sum(axis=0)
        squares += np.einsum("ij,ij->j", own, own)
        if len(x) > 1:
            dots = np.einsum("ij,ij->i", x[1:], x[:-1])
            alike += (dots.sum(), (dots ** 2).sum())
            alike2 += float((dots > 0.999).sum())
    mean = total / n
    out[:DIMENSIONS] = mean
    out[DIMENSIONS:2 * DIMENSIONS] = np.sqrt(np.maximum(squares / n - mean ** 2, 0))
    out[-4:] = [*(alike / max(1, n - 1)), alike2 / max(1, n - 1), np.log1p(n)]
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, the hash ``row`` of its text, and pooled features (packed floats) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            pooled = [pool(slots.of(text), vectors).tobytes() for text in _texts([batch], 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pooled, pa.binary())], ["doc_id", "row", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_of().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, features binary")


@dataclass
class Network:
    """Two layers over standardised features, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        """x: features in a fixed order, y: labels. A sixth is for the temperature."""
        rng = np.random.default_rng(seed)
        if len(y) < 12 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            return Network(np.zeros(POOLED), np.ones(POOLED), [
                np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), np.log(share / (1 - share))])
        order = rng.permutation(len(y))
        held, used = order[:len(y) // 6], order[len(y) // 6:]
        net = Network(x[used].mean(axis=0), x[used].std(axis=0) + 1e-3, [
            rng.normal(0, POOLED ** -0.5, (POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(())])
        z = (x - net.mean) / net.scale
        first, second, step = [np.zeros_like(w) for w in net.layers], [np.zeros_like(w) for w in net.layers], 0
        for _ in range(EPOCHS if len(used) * EPOCHS >= 100 * BATCH else 100 * BATCH // len(used)):
            rng.shuffle(used)
            for at in range(0, len(used), BATCH):
                some = used[at:at + BATCH]
                w1, b1, w2, b2 = net.layers
                hidden = np.tanh(z[some] @ w1 + b1)
                off = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[some]) / len(some)
                back = np.outer(off, w2) * (1 - hidden ** 2)
                grads = [z[some].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ off + DECAY * w2, off.sum()]
                step += 1
                for n, g in enumerate(grads):
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g ** 2
                    net.layers[n] = net.layers[n] - RATE * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
        logits = net.logits(x[held])
        sign = np.where(y[held] > 0, -1.0, 1.0)
        grid = np.geomspace(0.25, 8, 61)
        net.temperature = float(grid[np.argmin([np.logaddexp(0, sign * logits / t).mean() for t in grid])])
        return net


def is_held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality (0 or 1). A null text is empty; a text
    without words has features of zero and is scored like any other. Repeated
    rows are scored alike; a label of a null or unknown doc_id is not used, and
    of several labels of a doc_id the smallest is. Without labels of both kinds
    the score is their share.
    """
    return _classified(docs, labels, train_rows, threshold).drop("row")


def _classified(docs: DataFrame, labels: DataFrame, train_rows: int, threshold: float) -> DataFrame:
    """What ``classify`` returns, and the hash ``row`` of each text."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~is_held_out())
    known = keep(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), "labels")
    marked = keep(features(docs, word_vectors(docs)), "features")
    # Which labels are learned from, where there are more than enough, is by hash.
    share = min(1.0, train_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    known = known.where(draw < int(share * (1 << 30)))
    # The sample's labels are a bounded list of some train_rows.
    sample = marked.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    rows = sample.orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.float32).reshape(-1, POOLED).astype(np.float64)
    net = Network.fit(x, rows.column("quality").to_numpy().astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, POOLED)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(net.score(x.astype(np.float64)), pa.float64())], ["doc_id", "row", "score"])

    scored = marked.mapInArrow(run, "doc_id long, row long, score double")
    return scored.select("doc_id", "row", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all columns.

    Rows that share a doc_id, or have none, are judged each by its own text.
    """
    # The rejected are the shorter list; while it is short, the texts need no shuffle to meet it.
    rejected = keep(_classified(docs, labels, TRAIN_ROWS, threshold).where("predicted = 0").select("doc_id", "row").distinct(), "rejected")
    return without_rows(docs, rejected)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
