"""Exact nearest-neighbour and diversity-aware ranking.

A batch of request vectors is scored against the store without pairing rows in
a join: each task holds one bounded block of requests, streams its part of the
store through a matrix product and keeps only the best ``k`` per request. What
leaves a task is therefore bounded by the requests, not by the store. Where the
store has many splits, growing shares of them are looked at first: the
``k``-th best of a share bounds the distance of a hit, so that in the end no
split emits rows beyond it, and what is shuffled does not grow with the splits.

A scan takes requests of both search types at once. Its state carries, for a
request that will be re-ranked, the vector of each candidate, and for all of
them the file that holds it, so that text is read from those files alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import vectors as V
from passagemill.operators.embedding import token_counts
from passagemill.session import keep, scratch_path
from passagemill.settings import HASH_DIM

# More than any store holds: a request for more gets everything, and sums of
# counts stay in 64 bits.
MOST_HITS = 1 << 40
# A block of requests is sent to the tasks only below this size; a larger
# batch is dealt into blocks, each with a scan of its own.
BROADCAST_BYTES = 64 * 1024 * 1024
# Best-so-far rows a task may hold for one block of requests; a row with its
# vector counts as several.
STATE_ROWS = 2_000_000
ROW_BYTES = 48
# Stores of more splits have distances bounded by shares of one split in so
# many, one after the other, before the full scan.
BOUND_SPLITS = 64
SHARES = (4096, 512, 64, 8)
# Requests asking for more hits than this keep no state in the task.
STATE_K = 1_000_000
# Requests asking for more hits than this are ranked by a distributed sort.
RANK_K = 4096
# Ranked ids (about 100 bytes each) are broadcast up to this many.
BROADCAST_HITS = 500_000
# Hits in more files than this have their text looked for in the whole store.
MOST_FILES = 10_000
# Cells of one score matrix, which is to stay in a core's cache, and pairs of
# one exact re-computation.
SCORE_CELLS = 1 << 20
EXACT_PAIRS = 8_192
# First merge level of the per-task results, so that one request's rows are
# not all ranked by one task.
MERGE_FANOUT = 32
# Rows of one batch that leaves a task.
EMIT_ROWS = 16_384
# Vectors of candidates that one task re-ranks at once.
MMR_GROUP_BYTES = 16 * 1024 * 1024
# Candidates that a pass of distributed MMR brings together, for each request.
MMR_AHEAD = 256


@dataclass
class Block:
    """Requests as arrays: ids, (n, dim) vectors, hits wanted, whether these
    carry their vectors, and the distance beyond which no row is a hit."""

    ids: pa.Array
    vectors: np.ndarray
    wanted: np.ndarray
    carry: np.ndarray
    bound: np.ndarray

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.ids.take(pa.array(rows)), *(x[rows] for x in (self.vectors, self.wanted, self.carry, self.bound)))


@dataclass
class Part:
    """Rows of the store as arrays: ids, files and (n, dim) vectors."""

    ids: pa.Array
    files: pa.Array
    vectors: np.ndarray


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must all have {dim} entries")
    lengths = pc.list_value_length(column)
    if len(column) and (pc.min(lengths).as_py() != dim or pc.max(lengths).as_py() != dim):
        raise ValueError(f"vectors must all have {dim} entries")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _running_sum(values: np.ndarray) -> np.ndarray:
    """Left-to-right row sums, equal to the column expressions' to the bit."""
    return np.cumsum(values, axis=1)[:, -1]


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(_running_sum(rows * rows))


@dataclass
class ScoredRows:
    """Rows of the store as a scorer takes them: a column each, those without a distance, and the length of the longest."""

    bad: np.ndarray
    widest: float
    form: np.ndarray


def true_cells(flags: np.ndarray) -> np.ndarray:
    """Numbers of the true cells where few are true: eight cells are looked at as one."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    cells = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.r_[cells[flat[cells]], whole + np.flatnonzero(flat[whole:])]


class Scorer:
    """Distances of one block of requests to rows of the store.

    Every metric is written as an inner product to be made large, so that one
    single-precision matrix product finds the few rows worth an exact look.
    """

    def __init__(self, block: Block, metric: str):
        if metric not in ("l2", "cosine", "dot"):
            raise ValueError(f"unknown metric: {metric}")
        self.metric = metric
        self.queries = np.asarray(block.vectors, dtype=np.float64)
        self.query_lengths = _lengths(self.queries)
        self.undefined = self._without_direction(self.query_lengths)
        form = self._request_form(slice(None))
        self.form_lengths = _lengths(form)
        # The last column takes what a product has to reach, so that a product below that is negative.
        self.single = np.zeros((len(form), form.shape[1] + 1), np.float32)
        with np.errstate(over="ignore"):
            self.single[:, :-1] = form
        self.products = np.empty(0, np.float32)

    def _request_form(self, some: slice | np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            form = np.column_stack([self.queries[some], np.ones(len(self.queries[some]))])
        else:
            form = self._scaled(self.queries[some], self.query_lengths[some])
        form[self.undefined[some]] = 0.0
        return form

    def _without_direction(self, lengths: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(lengths)
        return bad | (lengths == 0) if self.metric == "cosine" else bad

    def _scaled(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return rows.copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            return rows / lengths[:, None]

    def rows(self, rows: np.ndarray, lengths: np.ndarray) -> ScoredRows:
        bad = self._without_direction(lengths)
        if self.metric == "l2":
            form = np.column_stack([rows, -0.5 * lengths**2])
        else:
            form = self._scaled(rows, lengths)
        form[bad] = 0.0
        widest = _lengths(form).max(initial=0.0)
        kind = np.float32 if max(widest, self.form_lengths.max(initial=0.0)) < 1e15 else np.float64
        last = np.full((1, len(form)), widest or 1.0)
        return ScoredRows(np.flatnonzero(bad), widest, np.concatenate([form.T, last]).astype(kind))

    def above(self, rows: ScoredRows, some: slice | np.ndarray, bound: np.ndarray, most: int) -> np.ndarray:
        """Which rows may be within ``bound`` of ``some`` requests; of those
        without a bound, the rows that may be among its ``most`` nearest."""
        kind, n = rows.form.dtype, rows.form.shape[1]
        reach = self.form_lengths[some] * rows.widest
        unit, least = (1.2e-7, 1e-30) if kind == np.float32 else (2.3e-16, 0.0)
        # The last column at most doubles a request's length, the last row adds as much as the widest row has.
        slack = 4 * (len(rows.form) + 4) * unit * reach + least
        if not np.isfinite(4 * reach.max(initial=0.0)):
            return np.ones((len(reach), n), bool)
        open_ = np.flatnonzero(np.isinf(bound))
        floor = np.clip(self.product_at(bound, some) - slack, -2 * reach, 2 * reach) / (rows.widest or 1.0)
        form = self.single[some] if kind == np.float32 else np.column_stack([self._request_form(some), floor])
        form[:, -1] = -floor
        if self.products.size < len(form) * n or self.products.dtype != kind:
            self.products = np.empty(len(form) * n, kind)
        products = np.matmul(form, rows.form, out=self.products[:len(form) * n].reshape(len(form), n))
        if len(rows.bad):
            products[:, rows.bad] = -np.inf
        above = products >= 0
        if len(open_):
            own = products[open_]
            if n > most:
                above[open_] = own >= (np.partition(own, n - most, axis=1)[:, n - most] - 2 * slack[open_])[:, None]
            else:
                above[open_] = True
        return above

    def product_at(self, distance: np.ndarray, some: slice | np.ndarray) -> np.ndarray:
        """The inner product that corresponds to a distance of each of ``some`` requests."""
        if self.metric == "l2":
            return (self.query_lengths[some]**2 - distance) / 2
        return 1 - distance if self.metric == "cosine" else -distance

    def exact(self, q: np.ndarray, rows: np.ndarray, i: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distances of the pairs (q, i); undefined ones are infinite."""
        out = np.empty(len(q))
        for start in range(0, len(q), EXACT_PAIRS):
            cut = slice(start, start + EXACT_PAIRS)
            a, b = rows[i[cut]], self.queries[q[cut]]
            if self.metric == "l2":
                out[cut] = _running_sum((a - b) ** 2)
            elif self.metric == "dot":
                out[cut] = -_running_sum(a * b)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[cut] = 1 - _running_sum(a * b) / (lengths[i[cut]] * self.query_lengths[q[cut]])
        out[np.isnan(out)] = np.inf
        return out


class BestRows:
    """The best ``k`` rows seen so far for each request of a block."""

    def __init__(self, block: Block, metric: str):
        self.block = block
        self.scorer = Scorer(block, metric)
        self.bound = block.bound.copy()
        #: Pieces of (request, distance, id, file, place of the vector or -1), and the vectors carried.
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]] = []
        self.vectors: list[np.ndarray] = []
        self.n_held, self.n_vectors, self.base = 0, 0, 0
        self.limit = 2 * int(block.wanted.sum()) + 100_000

    def add(self, part: Part, some: np.ndarray | None = None) -> None:
        """Look at rows for all requests, or only for the numbers ``some``."""
        every = np.arange(len(self.bound)) if some is None else some
        lost = self.scorer.undefined[every]
        if lost.any():
            self._add_least(part, every[lost])
            some = every = every[~lost]
        # Long pieces of the rows for few requests, squares for many.
        step = max(1, isqrt(SCORE_CELLS), SCORE_CELLS // max(1, len(every)))
        width = max(1, SCORE_CELLS // step)
        for start in range(0, len(part.vectors), step):
            narrow = part.vectors[start:start + step]
            wide = narrow.astype(np.float64)
            lengths = _lengths(wide)
            rows = self.scorer.rows(wide, lengths)
            bounded = True
            for low in range(0, len(every), width):
                numbers = every[low:low + width]
                bound = self.bound[numbers]
                unbounded = np.isinf(bound)
                bounded &= not unbounded.any()
                most = int(self.block.wanted[numbers[unbounded]].max(initial=1))
                above = self.scorer.above(rows, slice(low, low + width) if some is None else numbers, bound, most)
                q, i = np.divmod(true_cells(above), len(wide))
                if not len(q):
                    continue
                q = numbers[q]
                d = self.scorer.exact(q, wide, i, lengths)
                within = d <= self.bound[q]
                self._hold(q[within], d[within], i[within], start, narrow, part)
                if self.n_held > self.limit:
                    self.compact()
            # Requests have a bound once they have seen ``k`` rows; where many are wanted, a sort for each piece would cost more.
            if not bounded and self.n_held > 2 * self.base:
                self.compact()

    def _add_least(self, part: Part, some: np.ndarray) -> None:
        """Requests that are equally far from every row take those of the least ids."""
        least = pc.sort_indices(part.ids).to_numpy()[:int(self.block.wanted[some].max())]
        # As many as are wanted by all of them may be too many at once.
        for number in some.tolist():
            i = least[:self.block.wanted[number]]
            self._hold(np.full(len(i), number), np.full(len(i), np.inf), i, 0, part.vectors, part)
            if self.n_held > self.limit:
                self.compact()

    def _hold(self, q: np.ndarray, d: np.ndarray, i: np.ndarray, start: int, vectors: np.ndarray, part: Part) -> None:
        place = np.full(len(q), -1)
        carried = self.block.carry[q]
        if carried.any():
            used, place[carried] = np.unique(i[carried], return_inverse=True)
            place[carried] += self.n_vectors
            self.vectors.append(vectors[used])
            self.n_vectors += len(used)
        at = pa.array(start + i)
        self.held.append((q, d, part.ids.take(at), part.files.take(at), place))
        self.n_held += len(q)

    def compact(self) -> pa.Table:
        columns = list(zip(*self.held)) or [[np.empty(0, np.int64)], [np.empty(0)], [pa.array([], pa.null())], [pa.array([], pa.null())], [np.empty(0, np.int64)]]
        q, d, place = (np.concatenate(columns[n]) for n in (0, 1, 4))
        ids, files = (pa.chunked_array(columns[n]) for n in (2, 3))
        if len(q):
            order = self._nearest(q, d, ids)
            q, d, place = q[order], d[order], place[order]
            ids, files = ids.take(pa.array(order)), files.take(pa.array(order))
            last = np.arange(len(q)) - np.searchsorted(q, q) == self.block.wanted[q] - 1
            self.bound[q[last]] = np.minimum(self.bound[q[last]], d[last])
            if self.n_vectors:
                used, place[place >= 0] = np.unique(place[place >= 0], return_inverse=True)
                self.vectors = [np.concatenate(self.vectors)[used]]
                self.n_vectors = len(used)
        table = pa.table({"q": q, "d": d, "id": ids, "file": files, "place": place}).combine_chunks()
        if len(q):
            self.held = [(q, d, table["id"].combine_chunks(), table["file"].combine_chunks(), place)]
            self.n_held = self.base = len(q)
        return table

    def _nearest(self, q: np.ndarray, d: np.ndarray, ids: pa.ChunkedArray) -> np.ndarray:
        """Numbers of the rows wanted, by request and distance; ids are compared where a tie has to be cut."""
        order = np.lexsort((d, q))
        q, d = q[order], d[order]
        position = np.arange(len(q)) - np.searchsorted(q, q)
        wanted = self.block.wanted[q]
        cut = np.flatnonzero(position == wanted)
        tied = cut[d[cut] == d[cut - 1]]
        if len(tied):
            at = np.full(len(self.bound), np.nan)
            at[q[tied]] = d[tied]
            rows = np.flatnonzero(d == at[q])
            ties = pa.table({"q": q[rows], "id": ids.take(pa.array(order[rows]))})
            order[rows] = order[rows][pc.sort_indices(ties, sort_keys=[("q", "ascending"), ("id", "ascending")]).to_numpy()]
        return order[position < wanted]

    def emit(self) -> Iterator[pa.RecordBatch]:
        table = self.compact()
        if len(table):
            vectors = self.vectors[0] if self.vectors else np.empty((0, self.block.vectors.shape[1]), np.float32)
            yield from _emit(self.block, *(table[c].to_numpy() for c in ("q", "d")), *(table[c].combine_chunks() for c in ("id", "file")),
                             table["place"].to_numpy(), vectors)


def _emit(block: Block, q: np.ndarray, d: np.ndarray, ids: pa.Array, files: pa.Array, place: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of hits; ``place`` says which of the ``vectors`` a hit carries."""
    dim = block.vectors.shape[1]
    for start in range(0, len(q), EMIT_ROWS):
        cut = slice(start, start + EMIT_ROWS)
        some, at = q[cut], place[cut]
        offsets = np.r_[0, np.cumsum(np.where(at >= 0, dim, 0))].astype(np.int32)
        carried = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors[at[at >= 0]].ravel()), mask=pa.array(at < 0))
        yield pa.RecordBatch.from_arrays(
            [block.ids.take(pa.array(some)), ids.slice(start, len(some)), pa.array(d[cut], mask=np.isinf(d[cut])), pa.array(block.wanted[some]),
             files.slice(start, len(some)), carried],
            ["q_id", "chunk_id", "distance", "k", "file", "vector"])


def _rank_stream(block: Block, metric: str, parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
    """Candidates of a block from a stream of parts of the store."""
    modest = block.part(np.flatnonzero(block.wanted <= STATE_K))
    greedy = block.part(np.flatnonzero(block.wanted > STATE_K))
    best = BestRows(modest, metric) if len(modest.ids) else None
    scorer = Scorer(greedy, metric) if len(greedy.ids) else None
    for part in parts:
        if best:
            best.add(part)
        if scorer:
            wide = part.vectors.astype(np.float64)
            lengths = _lengths(wide)
            every = np.arange(len(wide))
            for number in range(len(greedy.ids)):
                d = scorer.exact(np.full(len(wide), number), wide, every, lengths)
                near = np.flatnonzero(d <= greedy.bound[number])
                place = near if greedy.carry[number] else np.full(len(near), -1)
                at = pa.array(near)
                yield from _emit(greedy, np.full(len(near), number), d[near], part.ids.take(at), part.files.take(at), place, part.vectors)
    if best:
        yield from best.emit()


def _candidate_schema(requests: DataFrame, store: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("q_id", requests.schema["q_id"].dataType),
        T.StructField("chunk_id", store.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("k", T.LongType()),
        T.StructField("file", T.LongType()),
        T.StructField("vector", store.schema["embedding"].dataType),
    ])


def _with_vector(rows):
    """A table or batch without the rows whose vector is missing."""
    return rows.filter(rows.column("embedding").is_valid()) if rows.column("embedding").null_count else rows


def _as_block(table: pa.Table, dim: int) -> Block:
    table = _with_vector(table).combine_chunks()
    ids, vectors = (table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("q_id", "embedding"))
    wanted = np.asarray(table["k"].to_numpy(), dtype=np.int64)
    return Block(ids, _matrix(vectors, dim), wanted, table["carry"].to_numpy().astype(bool), np.full(len(wanted), np.inf))


def _file() -> Column:
    """The file that holds a row, as a number."""
    return F.xxhash64("_metadata.file_path")


def _located(store: DataFrame) -> DataFrame:
    """(chunk_id, embedding, file); the file is null where rows come from none."""
    hidden = store._jdf.queryExecution().analyzed().metadataOutput()
    stored = any(hidden.apply(n).name() == "_metadata" for n in range(hidden.size()))
    return store.select("chunk_id", "embedding", (_file() if stored else F.lit(None).cast("long")).alias("file"))


def _scan_candidates(block: Block, rows: DataFrame, schema: T.StructType, metric: str, share: int = 1) -> DataFrame:
    """One pass over the store, or one of ``share`` splits of it, with the whole request block in every task."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    dim = block.vectors.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % share:
            return
        present = map(_with_vector, batches)
        parts = (Part(b.column("chunk_id"), b.column("file"), _matrix(b.column("embedding"), dim)) for b in present)
        yield from _rank_stream(shared.value, metric, parts)

    return rows.mapInArrow(scan, schema)


def _splits(rows: DataFrame) -> int:
    """About how many tasks a scan has; 1 where Spark does not know the size."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = rows._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    return 1 if size >= 1 << 60 else size // each


def _bounded(block: Block, rows: DataFrame, schema: T.StructType, metric: str, most: int, shares: list[int]) -> Block:
    """The block with distances beyond which no row is a hit.

    The ``k``-th best row of a part of the store is as far as a hit may be.
    Each share holds the one before, and its rows beyond what that one said
    are not emitted, so a step emits some ``k`` rows times the ratio of shares.
    """
    light = replace(block, carry=np.zeros(len(block.ids), bool), bound=block.bound.copy())
    for share in shares:
        found = _rank(_scan_candidates(light, rows, schema, metric, share), most).where("rank = k AND distance IS NOT NULL")
        last = found.select("q_id", "distance").toArrow()
        at = pc.index_in(last["q_id"].combine_chunks(), block.ids).to_numpy(zero_copy_only=False)
        light.bound[at] = np.minimum(light.bound[at], last["distance"].to_numpy())
    return replace(light, carry=block.carry)


def nearest(
    requests: DataFrame, store: DataFrame, metric: str = "l2", broadcast_bytes: int = BROADCAST_BYTES, bound_splits: int = BOUND_SPLITS,
) -> DataFrame:
    """The ``k`` nearest chunks of every request, exactly.

    ``requests(q_id, embedding, k)``, ``store(chunk_id, embedding)``; both ids
    are unique. Returns (q_id, rank, chunk_id, distance, file, vector), ties
    broken by id. ``vector`` is the hit's own for requests whose column
    ``carry`` is true, else null; ``file`` tells where the hit is stored.

    One pass over the store serves all requests that may be broadcast. More of
    them are dealt into blocks by a hash, and each block has a pass; rows of
    the store are never shuffled.
    """
    spark = store.sparkSession
    carry = F.coalesce("carry", F.lit(False)) if "carry" in requests.columns else F.lit(False)
    # Requests are read several times below, but embedded once.
    queries = keep(requests.where("k > 0").select(
        "q_id", F.col("embedding").cast("array<double>").alias("embedding"), F.least(F.col("k").cast("long"), F.lit(MOST_HITS)).alias("k"),
        carry.alias("carry")), "requests")
    # Missing vectors are dropped in the tasks: a filter on the column here
    # would compute embeddings that come from a function a second time.
    rows = _located(store)
    schema = _candidate_schema(requests, rows)
    held = F.least("k", F.lit(STATE_K))
    dim, most, count, state, carried = queries.where("embedding IS NOT NULL").agg(
        F.max(F.size("embedding")), F.max("k"), F.count("*"), F.sum(held), F.sum(F.when(F.col("carry"), held).otherwise(0))).first()
    if dim is None:
        return spark.createDataFrame([], _ranked_schema(schema))
    splits = _splits(rows)
    shares = [share for share in SHARES if splits >= share] if splits >= bound_splits else []

    def ranked(table: pa.Table) -> DataFrame:
        block = _bounded(_as_block(table, dim), rows, schema, metric, most, shares)
        return _rank(_scan_candidates(block, rows, schema, metric), most).select(_ranked_schema(schema).names)

    blocks = max(-(-count * 8 * dim // broadcast_bytes), -(-int(state + carried * 8 * dim / ROW_BYTES) // STATE_ROWS))
    if blocks <= 1:
        return ranked(queries.toArrow())
    dealt = scratch_path(spark, "request-blocks")
    queries.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks))).write.partitionBy("block").parquet(dealt)
    paths = []
    for number in range(blocks):
        table = spark.read.schema(queries.schema.add("block", "long")).parquet(dealt).where(F.col("block") == number).toArrow()
        if len(table):
            paths.append(scratch_path(spark, "block-hits"))
            keep(ranked(table), "block-hits", paths[-1])
    return spark.read.schema(_ranked_schema(schema)).parquet(*paths)


def knn_batch(requests: DataFrame, store: DataFrame, metric: str = "l2", **options) -> DataFrame:
    """(q_id, rank, chunk_id, distance) of the ``k`` nearest chunks; see ``nearest``."""
    return nearest(requests.select("q_id", "embedding", "k"), store, metric, **options).select("q_id", "rank", "chunk_id", "distance")


def _ranked_schema(schema: T.StructType) -> T.StructType:
    q, chunk, distance, _, file, vector = schema.fields
    return T.StructType([q, T.StructField("rank", T.LongType()), chunk, distance, file, vector])


def _rank(candidates: DataFrame, most: int) -> DataFrame:
    """Candidates with their ``rank``, by whichever way suits each request's ``k``."""
    if most <= RANK_K:
        return _rank_few(candidates, most)
    candidates = keep(candidates, "candidates")
    return _rank_few(candidates.where(F.col("k") <= RANK_K), RANK_K).unionByName(_rank_many(candidates.where(F.col("k") > RANK_K)))


def _rank_few(candidates: DataFrame, most: int | None) -> DataFrame:
    nearest = [F.asc_nulls_last("distance"), F.asc("chunk_id")]
    sliced = candidates.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(MERGE_FANOUT)))
    within = Window.partitionBy("q_id", "slice").orderBy(*nearest)
    overall = Window.partitionBy("q_id").orderBy(*nearest)
    wanted = F.col("rank") <= F.col("k")
    if most is not None:
        wanted = wanted & (F.col("rank") <= F.lit(int(most)))
    return (
        sliced.withColumn("rank", F.row_number().over(within)).where(wanted)
        .withColumn("rank", F.row_number().over(overall)).where(wanted)
        .withColumn("rank", F.col("rank").cast("long")).drop("slice")
    )


def rank_hits(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Number (q_id, chunk_id, distance, k) per request from 1 and keep ``k``.

    ``most``, no less than any ``k``, lets Spark drop rows before the shuffle.

    Ranked in two levels: within a slice of the tasks' results, then among the
    survivors, so a request's candidates never meet in one task all at once.
    """
    return _rank_few(candidates, most).select("q_id", "rank", "chunk_id", "distance")


def rank_long(candidates: DataFrame) -> DataFrame:
    """``rank_hits`` for requests that want very many rows.

    Rows are range-partitioned over (request, distance, id), so even a single
    request spreads over all tasks; a row's rank is its place within its
    partition plus the request's rows in the partitions before.
    """
    return _rank_many(candidates).select("q_id", "rank", "chunk_id", "distance")


def _rank_many(candidates: DataFrame) -> DataFrame:
    spark = candidates.sparkSession
    order = [F.asc("q_id"), F.asc_nulls_last("distance"), F.asc("chunk_id")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written out so that the partition numbers stay what they are.
    placed = keep(candidates.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("q_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("q_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("q_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("q_id", "part").orderBy(F.asc_nulls_last("distance"), F.asc("chunk_id"))
    # Requests times tasks rows.
    ranked = placed.withColumn("place", F.row_number().over(within)).join(offsets, ["q_id", "part"])
    return ranked.withColumn("rank", F.col("offset") + F.col("place")).where("rank <= k").select(*candidates.columns, "rank")


def sparse_search(requests: DataFrame, chunks: DataFrame, dim: int = HASH_DIM, **options) -> DataFrame:
    """Rank by the cosine of hashed term counts.

    ``requests(q_id, query, k)``, ``chunks(chunk_id, content)``. The product
    over shared terms is taken inside the store scan: joining on the term
    would pair every request with every chunk that has a common word. Counts
    are whole numbers, so scores are exact in any order.
    """
    asked = requests.select("q_id", "k", token_counts(F.col("query"), dim).alias("embedding"))
    rows = chunks.select("chunk_id", token_counts(F.col("content"), dim).alias("embedding"))
    return knn_batch(asked, rows, "cosine", **options)


def knn_topk(query: list[float], store: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest chunks of one vector; a top-n, not a full sort, unless ``k`` is very large."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    near = store.where("embedding is not null").select("chunk_id", V.distance(F.col("embedding"), vector, metric).alias("distance"))
    order = [F.asc_nulls_last("distance"), F.asc("chunk_id")]
    if k > RANK_K:
        asked = near.select(F.lit(0).alias("q_id"), "chunk_id", "distance", F.lit(k).cast("long").alias("k"))
        return rank_long(asked).select("rank", "chunk_id", "distance")
    near = near.orderBy(*order).limit(max(k, 0))
    return near.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "chunk_id", "distance")


def fetch_candidates(requests: DataFrame, store: DataFrame, metric: str = "l2", **options) -> DataFrame:
    """First stage of ``mmr``: the ``fetch_k`` nearest of every request."""
    return knn_batch(requests.withColumn("k", F.col("fetch_k")), store, metric, **options)


def _cosines(rows: np.ndarray, lengths: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosine of each row with ``vector``; undefined counts as unrelated (0)."""
    scale = lengths * _lengths(vector[None, :])[0]
    return np.divide(_running_sum(rows * vector), scale, out=np.zeros(len(rows)), where=scale > 0)


def _mmr_picks(query: np.ndarray, rows: np.ndarray, k: int, weight: float) -> list[int]:
    """Positions picked, given candidates in first-stage order."""
    lengths = _lengths(rows)
    relevance = _cosines(rows, lengths, query)
    return _greedy(rows, relevance, np.full(len(rows), -np.inf), k, weight, None)


def _greedy(rows: np.ndarray, relevance: np.ndarray, redundancy: np.ndarray, k: int, weight: float, rest: tuple[float, int] | None) -> list[int]:
    """Positions picked from candidates in order of their rank.

    ``redundancy`` is -inf as long as nothing has been picked. ``rest`` bounds
    rows that are not here: the score of the best of them, and how many of the
    candidates have a better rank; a pick that it may beat is left for another
    pass.
    """
    lengths = _lengths(rows)
    score = relevance if np.isneginf(redundancy).all() else weight * relevance - (1 - weight) * redundancy
    score = score.copy()
    picks: list[int] = []
    for _ in range(min(k, len(rows))):
        pick = int(np.argmax(score))
        if rest is not None and (score[pick], -pick) < (rest[0], 0.5 - rest[1]):
            break
        picks.append(pick)
        redundancy = np.maximum(redundancy, _cosines(rows, lengths, rows[pick]))
        score = weight * relevance - (1 - weight) * redundancy
        score[picks] = -np.inf
    return picks


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _mmr_positions(query: pa.Array, found: pa.Array, k: pa.Array, weight: pa.Array) -> pa.Array:
    """Positions picked from each request's candidate vectors."""
    picks = []
    for vector, rows, wanted, one_weight in zip(query, found, k, weight):
        target = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = _matrix(rows.values, len(target)).astype(np.float64)
        picks.append(_mmr_picks(target, matrix, wanted.as_py(), one_weight.as_py()))
    return pa.array(picks, pa.list_(pa.int32()))


def _mmr_bounded(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Re-rank each request's candidates (at most ``fetch_k``) in one row."""
    gathered = found.groupBy("q_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "distance", "file", "vector"))).alias("found")
    )
    picked = gathered.join(asked, "q_id").select(
        "q_id", "found", F.posexplode_outer(_mmr_positions("embedding", "found.vector", "k", "lambda_mult")).alias("turn", "pick")
    ).where("turn is not null")
    chosen = F.col("found")[F.col("pick")]
    return picked.select(
        "q_id", (F.col("turn") + 1).cast("long").alias("rank"), *(chosen[c].alias(c) for c in ("chunk_id", "distance", "file"))
    )


PICKED = "turn long, chunk_id {id}, distance double, file long, vector {vector}"


def _mmr_passes(requests: DataFrame, found: DataFrame, ahead: int) -> DataFrame:
    """Distributed candidates, for very large ``fetch_k``, written once and never again.

    A row's score only falls while rows are picked, so what it was bounds what
    it will be. Each pass scores all rows against the picks so far, brings the
    best ``ahead`` of each request together, and picks from them for as long as
    no other row may do better. Only picks are kept between passes; a request's
    candidates never meet.
    """
    asked = requests.select("q_id", F.col("embedding").alias("q_vec"), "k", "lambda_mult")
    relevance = F.coalesce(V.cosine(F.col("vector"), F.col("q_vec")), F.lit(0.0))
    rows = keep(found.join(asked, "q_id").select(
        "q_id", "rank", "chunk_id", "distance", "file", "vector", "k", "lambda_mult", relevance.alias("relevance")), "candidates")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kind = PICKED.format(id=fields["chunk_id"], vector=fields["vector"])
    picked = keep(rows.limit(0).select("q_id", F.lit(0).cast("long").alias("turn"), "chunk_id", "distance", "file", "vector"), "picked")
    # What each request gets in the end: as many rows as it asks for, or has.
    total = rows.groupBy("q_id").agg(F.least(F.max("k").cast("long"), F.count("*")).alias("total"))
    total = keep(total, "totals")
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 1

    def choose(group: pa.Table) -> pa.Table:
        table = group.sort_by([("place", "ascending")])
        scores, ranks = table["score"].to_numpy(), table["rank"].to_numpy()
        # The last row stands for all that are not here.
        last = (scores[-1], int(ranks[-1])) if len(table) > ahead else None
        table = table.slice(0, ahead).sort_by([("rank", "ascending")])
        ranks = table["rank"].to_numpy()
        vectors = table["vector"].combine_chunks()
        matrix = _matrix(vectors, len(vectors[0])).astype(np.float64)
        redundancy = table["redundancy"].to_numpy(zero_copy_only=False).astype(np.float64)
        redundancy = np.where(np.isnan(redundancy), -np.inf, redundancy)
        done, wanted, weight = (table[c][0].as_py() for c in ("done", "total", "lambda_mult"))
        rest = None if last is None else (last[0], int(np.searchsorted(ranks, last[1])))
        # The first pick is by relevance alone, which does not bound later scores.
        most = 1 if not done and rest else wanted - done
        picks = _greedy(matrix, table["relevance"].to_numpy(), redundancy, most, weight, rest)
        chosen = table.take(pa.array(picks, pa.int64()))
        turns = pa.array(np.arange(done + 1, done + 1 + len(picks)), pa.int64())
        return chosen.select(["q_id", "chunk_id", "distance", "file", "vector"]).add_column(1, "turn", turns)

    while True:
        had = picked.groupBy("q_id").agg(F.count("*").alias("done"), F.collect_list("vector").alias("taken"), F.collect_list("chunk_id").alias("gone"))
        open_ = keep(total.join(had, "q_id", "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long"))).where("done < total"), "open")
        many, most = open_.agg(F.count("*"), F.coalesce(F.max("done"), F.lit(0))).first()
        if not many:
            return picked.select("q_id", F.col("turn").alias("rank"), "chunk_id", "distance", "file")
        few = F.broadcast(open_) if many * (most + 1) * dim * 8 <= BROADCAST_BYTES else open_
        redundancy = F.array_max(F.transform("taken", lambda v: F.coalesce(V.cosine(F.col("vector"), v), F.lit(0.0))))
        scored = rows.join(few, "q_id").where("gone IS NULL OR NOT array_contains(gone, chunk_id)").withColumn("redundancy", redundancy)
        score = F.when(F.col("redundancy").isNull(), F.col("relevance")).otherwise(
            F.col("lambda_mult") * F.col("relevance") - (1 - F.col("lambda_mult")) * F.col("redundancy"))
        place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("rank")))
        best = scored.withColumn("score", score).drop("taken", "gone").withColumn("place", place).where(F.col("place") <= ahead + 1)
        new = best.groupBy("q_id").applyInArrow(choose, f"q_id {fields['q_id']}, {kind}")
        picked = keep(picked.unionByName(new), "picked")


def rerank(requests: DataFrame, found: DataFrame, group_bytes: int = MMR_GROUP_BYTES, ahead: int = MMR_AHEAD) -> DataFrame:
    """(q_id, rank, chunk_id, distance, file) by maximal marginal relevance.

    ``requests(q_id, embedding, k, fetch_k, lambda_mult)`` with their candidates
    ``found(q_id, rank, chunk_id, distance, file, vector)``, at most ``fetch_k``
    each. Relevance and redundancy are cosines; ties go to the better rank.
    Candidates beyond ``group_bytes`` of vectors are never brought together.
    """
    asked = requests.select("q_id", "embedding", "k", "fetch_k", "lambda_mult")
    large = F.coalesce(F.col("fetch_k").cast("double") * F.size("embedding") * 8 > group_bytes, F.lit(False))
    if asked.where(large).isEmpty():
        return _mmr_bounded(asked, found)
    found = keep(found, "candidates")
    few, many = (found.join(asked.where(side).select("q_id"), "q_id", "left_semi") for side in (~large, large))
    return _mmr_bounded(asked.where(~large), few).unionByName(_mmr_passes(asked.where(large), many, ahead))


def mmr(
    requests: DataFrame, store: DataFrame, metric: str = "l2", group_bytes: int = MMR_GROUP_BYTES, ahead: int = MMR_AHEAD, **options,
) -> DataFrame:
    """Maximal marginal relevance over the ``fetch_k`` nearest chunks.

    ``requests(q_id, embedding, k, fetch_k, lambda_mult)``. The result has
    min(k, fetch_k, candidates) rows per request; the store is scanned once.
    """
    wanted = requests.where("k > 0 and fetch_k > 0")
    near = nearest(wanted.select("q_id", "embedding", F.col("fetch_k").alias("k"), F.lit(True).alias("carry")), store, metric, **options)
    return rerank(wanted, near, group_bytes, ahead).drop("file")


def join_hits(hits: DataFrame, rows: DataFrame, requests: DataFrame, limit_col: str = "k") -> DataFrame:
    """Join ranked ids with columns of the store.

    There are at most as many hits as the requests asked for in total. Below
    ``BROADCAST_HITS`` they are broadcast and the store is only scanned; above
    that both sides are shuffled by id.
    """
    most = requests.agg(F.coalesce(F.sum(F.greatest(F.least(F.col(limit_col).cast("long"), F.lit(MOST_HITS)), F.lit(0))), F.lit(0))).first()[0]
    return rows.join(F.broadcast(hits) if most <= BROADCAST_HITS else hits, "chunk_id")


def _files_of(hits: DataFrame) -> list[int] | None:
    """The files that hold the hits, unless there are too many or one is unknown."""
    files = [row[0] for row in hits.select("file").distinct().limit(MOST_FILES + 1).collect()]
    return None if len(files) > MOST_FILES or None in files else files


def attach_content(hits: DataFrame, store: DataFrame, requests: DataFrame) -> DataFrame:
    """Text and metadata of ranked ids; only ids and scores were shuffled.

    Hits that say which ``file`` holds them (a written table, as it is read
    twice) have their text read from those files alone.
    """
    rows = store
    if "file" in hits.columns:
        files = _files_of(hits)
        # Spark leaves out files by this condition before it reads anything.
        rows = store if files is None else store.where(_file().isin(files))
        hits = hits.drop("file")
    return join_hits(hits, rows.drop("embedding", "hash"), requests)
