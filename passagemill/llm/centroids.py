"""Centroid clustering with a Walsh-Hadamard progressive search.

Vectors of integers are assigned to the nearest of a few centroids, exactly.
Both are put through the integer Walsh-Hadamard transform, whose rows are
orthogonal and of equal length, so squared distances of the coefficients are
``WIDTH`` times those of the vectors. Coefficients stand in dyadic order: the
first ones are signed sums over long runs of components, the coarse shape of a
vector. A search adds up squared differences of coefficients coarse to fine.
What has been added bounds a distance from below; the full distance of the
centroid that looks best bounds the least one from above. A centroid whose sum
is above that bound is strictly worse and goes; the others, ties included,
come to all ``WIDTH`` coefficients.

A round is one pass over the vectors, a written table. The centroids go to the
tasks with the code (at most ``CENTROIDS`` times ``WIDTH`` numbers); each task
returns sums and counts by centroid, which Spark adds up, and those few rows
make the next centroids. A lost executor costs the tasks it ran.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import table
from passagemill.session import keep

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Coefficients that are added before each elimination.
LEVELS = (4, 8, 16, 32, 64)
#: Components up to this magnitude keep every step within 64 bits; beyond it Python's integers are used.
NARROW = 1 << 24
#: Vectors that a task searches for at once.
BLOCK = 4096


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, exact, in dyadic order."""
    out = vectors
    n = out.shape[1]
    half = n // 2
    while half:
        # Runs of 2 * half neighbours; sums of the two halves come before their differences.
        pair = out.reshape(len(out), -1, 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(vectors), n)
        half //= 2
    order = np.arange(n)
    bits = n.bit_length() - 1
    dyadic = np.array([int(f"{k:0{bits}b}"[::-1], 2) if bits else 0 for k in order])
    return out[:, dyadic]


def nearest(vectors: np.ndarray, centroids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row (the smaller one of a tie),
    its squared distance, and how many coefficients were compared.

    ``vectors`` and ``centroids`` hold coefficients of ``transform``.
    """
    n, width = vectors.shape
    row, centroid = np.repeat(np.arange(n), len(centroids)), np.tile(np.arange(len(centroids)), n)
    total = np.zeros(len(row), vectors.dtype)
    bound = None
    compared, done = 0, 0
    for level in levels:
        delta = vectors[row, done:level] - centroids[centroid, done:level]
        total = total + (delta * delta).sum(axis=1)
        compared += delta.size
        done = level
        if done == width:
            break
        # The first centroid with a row's least sum so far, and its full distance.
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(total, starts)
        at_least = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        best = at_least[np.r_[True, row[at_least][1:] != row[at_least][:-1]]]
        rest = vectors[row[best], done:] - centroids[centroid[best], done:]
        compared += rest.size
        full = total[best] + (rest * rest).sum(axis=1)
        bound = full if bound is None else np.minimum(bound, full)
        stays = total <= bound[row]
        row, centroid, total = row[stays], centroid[stays], total[stays]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, starts)
    winners = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    winners = winners[np.r_[True, row[winners][1:] != row[winners][:-1]]]
    return centroid[winners], total[winners] // width, compared


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a batch's vectors, in 64 bits where all are narrow enough."""
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)
    if not scaled.size or np.abs(scaled).max() <= NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in line] for line in scaled.tolist()], object)


def _kind(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    wide = vectors.dtype == object or max((abs(x) for c in centroids for x in c), default=0) > NARROW
    return np.array(centroids, object if wide else np.int64)


def _searched(batch: pa.RecordBatch, centroids: list[list[int]]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """A part of the batch, its vectors, and their clusters and distances."""
    for at in range(0, batch.num_rows, BLOCK):
        part = slice(at, min(batch.num_rows, at + BLOCK))
        vectors = _matrix(batch.column("embedding").slice(part.start, part.stop - part.start))
        means = _kind(vectors, centroids)
        vectors = vectors.astype(means.dtype)
        cluster, distance, _ = nearest(transform(vectors), transform(means))
        yield part, vectors, cluster, distance


def valid(vectors: Column, width: int = WIDTH) -> Column:
    """Whether an array of doubles has ``width`` components, none null, NaN or infinite."""
    good = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vectors) == width) & good, F.lit(False))


def _first(rows: DataFrame, count: int, seed: int) -> list[list[int]]:
    """Vectors with the smallest hashes of their ids; without an id a vector comes last, and equal ids are in order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(count)
    return [[int(np.floor(SCALE * x)) for x in r.embedding] for r in first.collect()]


def _next(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's mean of the vectors assigned to it, rounded down; one without vectors stays."""
    width = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), width), object)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, vectors, cluster, _ in _searched(batch, centroids):
                for c in np.unique(cluster).tolist():
                    some = vectors[cluster == c]
                    sums[c] += some.sum(axis=0).astype(object)
                    counts[c] += len(some)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width), pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()),
             pa.array(np.repeat(counts[some], width)), pa.array([Decimal(x) for x in sums[some].ravel().tolist()], pa.decimal128(38, 0))],
            ["cluster", "place", "n", "total"])

    partial = rows.select("embedding").mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    added = partial.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [list(c) for c in centroids]
    for r in added.collect():
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256
    of the rows of ``vectors`` (vec_id, embedding) with ``width`` finite components.

    ``width`` is a power of two from 64 on. Null vectors, and those with another
    number of components or one that is null, NaN or infinite, are left out;
    other columns are not read. Rows that repeat an id are vectors of their own.
    A row without an id becomes a first centroid only where too few have one.
    With fewer vectors than ``count`` there are as many centroids as vectors;
    an empty table has no row. Of equally near centroids the smaller number
    wins. A squared distance or a sum beyond 64 bits (components of some 10^6
    and more) fails as an overflow; nothing is rounded.
    """
    wide = F.col("embedding").cast("array<double>")
    rows = keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding")).where(valid(F.col("embedding"), width)), "vectors")
    centroids = _first(rows, count, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _next(rows, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, found, distance in _searched(batch, centroids):
                ids = batch.column("vec_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(found, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = keep(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    # One row for each centroid, so at most ``count`` of them.
    named = vectors.sparkSession.createDataFrame(
        [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every valid vector."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {WIDTH}
), round0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM kept
  ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS}
)"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
, near{n} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {square}, 'cluster': cluster}}) AS best FROM kept, round{n} GROUP BY row
)""")
        if n < ROUNDS:
            parts.append(f"""
, sums{n} AS (
  SELECT best.cluster AS cluster, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{n}) GROUP BY ALL
), mean{n} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM sums{n} GROUP BY cluster
), round{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, r.c) AS c FROM round{n} r LEFT JOIN mean{n} m USING (cluster)
)""")
    parts.append(f"""
SELECT vec_id, best.cluster AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN round{ROUNDS} r ON n.best.cluster = r.cluster
""")
    return "".join(parts)


SQL = _sql()
