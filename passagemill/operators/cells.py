"""Exact search over a store laid out in metric cells.

Every vector lies in the cell of its nearest centre, each cell is a folder,
and a small table keeps a cell's centre, its radius (the distance of its
farthest vector) and its number of rows. By the triangle inequality no vector
of a cell is nearer to a request than the centre's distance less the radius,
and none is farther than that distance plus the radius. Cells that together
hold ``k`` rows bound the distance of a hit from above; a cell whose nearest
possible vector lies beyond that bound is not read for the request. Bounds are
widened by more than rounding may take, so results equal those of a full scan.

The cosine is a Euclidean distance between unit vectors; rows without a
direction rank last and lie in a cell of their own, which is read when the
others may not hold ``k`` rows. The inner product is no metric and has no cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.search import (
    BROADCAST_BYTES, MOST_HITS, STATE_K, STATE_ROWS, BestRows, Block, Part, _candidate_schema, _matrix, _rank, _ranked_schema, _with_vector,
    knn_batch,
)
from passagemill.session import keep

CELLS = 256
#: The cell of rows that have no direction, or no finite length.
ASIDE = -1
#: Relative widening of distances; sums over a vector's entries err by far less.
MARGIN = 1e-9
TABLE = "cell int, centre array<double>, radius double, n long"
PLANNED = "q_id {q}, embedding array<double>, k long, bound double, cells array<int>"


def _points(rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows as points of a Euclidean space, and which rows are none."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no cells for the metric {metric}")
    wide = rows.astype(np.float64)
    lengths = np.sqrt((wide * wide).sum(axis=1))
    bad = ~np.isfinite(lengths) | (lengths == 0 if metric == "cosine" else False)
    wide[bad] = 0.0
    if metric == "cosine":
        wide[~bad] /= lengths[~bad, None]
    return wide, bad


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, without cancellation."""
    out = np.empty((len(points), len(centres)))
    for n, centre in enumerate(centres):
        out[:, n] = np.sqrt(((points - centre) ** 2).sum(axis=1))
    return out


def write_cells(store: DataFrame, path: str, metric: str = "l2", cells: int = CELLS) -> None:
    """Lay out ``store`` (chunk_id, embedding and more) in cells below ``path``.

    The centres are the vectors of the ``cells`` chunks with the smallest
    hashes of their ids: few rows, whatever the store's size. Rows without a
    vector are left out. A folder that exists is an error.
    """
    spark = store.sparkSession
    order = [F.xxhash64("chunk_id"), F.col("chunk_id")]
    first = store.where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(*order).limit(cells).toArrow()
    centres = np.zeros((0, 0))
    if len(first):
        vectors = first["embedding"].combine_chunks()
        points, bad = _points(_matrix(vectors, len(vectors[0])), metric)
        centres = np.unique(points[~bad], axis=0)

    @F.arrow_udf("struct<cell:int,away:double>")
    def cell_of(vectors: pa.Array) -> pa.Array:
        cell, away = np.full(len(vectors), ASIDE, np.int32), np.zeros(len(vectors))
        if len(centres) and len(vectors):
            points, bad = _points(_matrix(vectors, centres.shape[1]), metric)
            # The nearest by inner products is near enough; the distance kept is the one to that centre.
            near = (points @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
            cell, away = np.where(bad, ASIDE, near).astype(np.int32), np.sqrt(((points - centres[near]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

    placed = store.where("embedding IS NOT NULL").withColumn("__place", cell_of("embedding"))
    placed = placed.select(*store.columns, F.col("__place.cell").alias("cell"), F.col("__place.away").alias("__away"))
    # A store without rows has a schema, too.
    placed.limit(0).write.parquet(f"{path}/schema")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    stats = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("__away").alias("radius"), F.count("*").alias("n"))
    # As many rows as cells.
    rows = [(r.cell, centres[r.cell].tolist() if r.cell >= 0 else None, r.radius, r.n) for r in stats.collect()]
    spark.createDataFrame(rows, TABLE).coalesce(1).write.parquet(f"{path}/cells-{metric}")


def _plan_block(points: np.ndarray, bad: np.ndarray, wanted: np.ndarray, table: list[tuple], metric: str) -> tuple[np.ndarray, list[list[int]]]:
    """For each request the distance beyond which no row is a hit, and the cells that may hold hits."""
    proper = [row for row in table if row[0] >= 0]
    aside = sum(row[3] for row in table if row[0] < 0)
    numbers = np.array([row[0] for row in proper], np.int32)
    sizes = np.array([row[3] for row in proper], np.int64)
    radius = np.array([row[2] for row in proper], np.float64)
    bounds, needed = np.full(len(points), np.inf), []
    if not len(proper):
        return bounds, [[ASIDE] if aside else [] for _ in points]
    away = _distances(points, np.array([row[1] for row in proper]))
    scale = MARGIN * (1 + away + radius)
    farthest, nearest = away + radius + scale, away - radius - scale
    everything = [*([ASIDE] if aside else []), *numbers.tolist()]
    for n in range(len(points)):
        order = np.argsort(farthest[n], kind="stable")
        enough = np.searchsorted(np.cumsum(sizes[order]), wanted[n])
        # A request without a direction is equally far from everything; one for more rows than there are reads all.
        if bad[n] or enough == len(order):
            needed.append(everything)
            continue
        limit = farthest[n, order[enough]]
        near = np.argsort(away[n], kind="stable")
        needed.append(numbers[near[nearest[n, near] <= limit]].tolist())
        squared = limit * limit * (1 + MARGIN)
        bounds[n] = squared if metric == "l2" else squared / 2 + MARGIN
    return bounds, needed


def plan_cells(requests: DataFrame, path: str, metric: str = "l2") -> DataFrame:
    """(q_id, embedding, k, bound, cells): the cells each request has to read, the one it lies in first.

    ``requests(q_id, embedding, k)``; those without a vector or with ``k`` below
    one have no row. ``bound`` is no less than the distance of any hit.
    """
    spark = requests.sparkSession
    # As many rows as cells.
    table = [tuple(r) for r in spark.read.schema(TABLE).parquet(f"{path}/cells-{metric}").collect()]
    dim = next((len(row[1]) for row in table if row[1]), 0)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            points, bad = _points(_matrix(vectors, dim or (len(vectors[0]) if len(vectors) else 1)), metric)
            bounds, needed = _plan_block(points, bad, batch.column("k").to_numpy(), table, metric)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("q_id", "embedding", "k")), pa.array(bounds), pa.array(needed, pa.list_(pa.int32()))],
                ["q_id", "embedding", "k", "bound", "cells"])

    wanted = requests.where("k > 0 AND embedding IS NOT NULL").select(
        "q_id", F.col("embedding").cast("array<double>").alias("embedding"), F.least(F.col("k").cast("long"), F.lit(MOST_HITS)).alias("k"))
    return wanted.mapInArrow(plan, PLANNED.format(q=requests.schema["q_id"].dataType.simpleString()))


def read_cells(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """The rows of some cells, or of all, with their ``cell``; other folders are not read."""
    schema = spark.read.parquet(f"{path}/schema").schema
    rows = spark.read.schema(schema).parquet(f"{path}/rows").drop("__away")
    return rows if cells is None else rows.where(F.col("cell").isin(cells))


def cells_read(requests: DataFrame, path: str, metric: str = "l2") -> DataFrame:
    """One row: cells and rows of the store, and how many of them a search for ``requests`` reads."""
    table = requests.sparkSession.read.schema(TABLE).parquet(f"{path}/cells-{metric}").select("cell", "n")
    needed = plan_cells(requests, path, metric).select(F.explode("cells").alias("cell")).distinct().withColumn("read", F.lit(1))
    both = table.join(needed, "cell", "left")
    return both.agg(
        F.count("*").alias("cells"), F.count("read").alias("cells_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("read") == 1, F.col("n"))), F.lit(0)).alias("rows_read"))


def knn_cells(requests: DataFrame, path: str, metric: str = "l2", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(q_id, rank, chunk_id, distance) of the ``k`` nearest chunks of a store in cells, exactly.

    A task looks at a cell's rows only for the requests that need the cell.
    Requests beyond ``broadcast_bytes`` are dealt into blocks of neighbours, so
    that a block needs few cells; each block is one scan. Requests for very
    many rows need nearly all cells and are left to ``knn_batch``.
    """
    spark = requests.sparkSession
    planned = keep(plan_cells(requests, path, metric), "planned")
    held = F.col("k") <= STATE_K
    dim, most, count, state, many = planned.agg(
        F.max(F.size("embedding")), F.max(F.when(held, F.col("k"))), F.count_if(held), F.sum(F.when(held, F.col("k"))), F.count_if(~held)).first()
    columns = ["q_id", "rank", "chunk_id", "distance"]
    schema = _candidate_schema(planned, read_cells(spark, path, []))
    found = [spark.createDataFrame([], _ranked_schema(schema)).select(*columns)]
    if many:
        found.append(knn_batch(planned.where(~held), read_cells(spark, path), metric, broadcast_bytes=broadcast_bytes))
    blocks = max(-(-count * 8 * (dim or 1) // broadcast_bytes), -(-(state or 0) // STATE_ROWS))
    dealt = planned.where(held)
    if blocks > 1:
        home = F.coalesce(F.get("cells", F.lit(0)), F.lit(ASIDE))
        dealt = keep(dealt.repartitionByRange(blocks, home, F.xxhash64("q_id"), "q_id").withColumn("block", F.spark_partition_id()), "planned")
    for number in range(blocks):
        table = (dealt.where(F.col("block") == number).drop("block") if blocks > 1 else dealt).toArrow().combine_chunks()
        if not len(table):
            continue
        block = Block(table["q_id"].combine_chunks(), _matrix(table["embedding"].combine_chunks(), dim), table["k"].to_numpy(),
                      np.zeros(len(table), bool), table["bound"].to_numpy().copy())
        by_cell: dict[int, list[int]] = {}
        for n, cells in enumerate(table["cells"].to_pylist()):
            for cell in cells:
                by_cell.setdefault(cell, []).append(n)
        hits = _rank(_scan_cells(spark, path, block, by_cell, schema, metric), most).select(*columns)
        found.append(keep(hits, "block-hits") if blocks > 1 else hits)
    return reduce(DataFrame.unionByName, found)


def _scan_cells(spark: SparkSession, path: str, block: Block, by_cell: dict[int, list[int]], schema, metric: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((block, {cell: np.array(some) for cell, some in by_cell.items()}))
    dim = block.vectors.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanting = shared.value
        best = BestRows(asked, metric)
        for batch in map(_with_vector, batches):
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                own = batch.filter(pa.array(cells == cell))
                best.add(Part(own.column("chunk_id"), own.column("file"), _matrix(own.column("embedding"), dim)), wanting[cell])
        yield from best.emit()

    rows = read_cells(spark, path, sorted(by_cell)).select("chunk_id", "embedding", F.lit(None).cast("long").alias("file"), "cell")
    return rows.mapInArrow(scan, schema)
