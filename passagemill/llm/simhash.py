"""SimHash near-duplicates, searched in BK-trees.

A text's fingerprint has a bit set where over half of the hashes of its word
shingles have it set; texts link when their fingerprints differ in few bits.
Equal fingerprints are merged first. Two fingerprints within ``r`` bits agree
on at least one of ``r + 1`` blocks of bits, so fingerprints are dealt into a
shard for each block and its value, and every possible link lies within a
shard. Each shard has a BK-tree: a child hangs below its parent by their
Hamming distance, and a query at distance ``d`` from a node follows only the
edges from ``d - r`` to ``d + r``.

A shard's tree goes by a keyed shuffle to the queries that need it; one
broadcast of all trees would grow with the corpus. A shard beyond
``shard_rows`` is dealt again: its fingerprints agree on a block, so those
within ``r`` bits agree on one of ``r + 1`` blocks of the bits left, too. A
fingerprint then has ``r + 1`` rows for each time its shard is dealt, however
many fingerprints there are. What is still larger after ``LEVELS`` times is cut
into trees, and each of its blocks of queries meets each tree in a task of its
own. A task returns a spanning forest of the links it found, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import components, free_name, row_of, split_by_ids, without_rows
from passagemill.session import keep

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of one tree at most; a larger shard is cut.
SHARD_ROWS = 4096
#: Times that fingerprints are dealt by blocks of bits.
LEVELS = 3
#: Rows of whole shards that a task works on at once, and (query, node) pairs that it holds at once.
CHUNK_ROWS = 200_000
FRONTIER = 2_000_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    last = len(words) - width + 1
    hashes = np.array(
        [digest(joined[s:e], 42) for s, e in zip(starts[:last].tolist(), ends[width - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, last, 32768):
        some = hashes[at:at + 32768]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, the hash ``row`` of its text, and its fingerprint ``fp`` as a signed long; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_of().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


class Forest:
    """BK-trees of several shards, side by side; row numbers are its nodes."""

    def __init__(self, fp: np.ndarray, rows: np.ndarray, group: np.ndarray):
        """rows: numbers of the rows to insert, sorted by their ``group``."""
        self.fp, keys, nodes, self.roots = fp, [], [], None
        while True:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(rows) else np.zeros(0, np.int64)
            if self.roots is None:
                self.roots = dict(zip(group[first].tolist(), rows[first].tolist()))
            else:
                keys.append(group[first])
                nodes.append(rows[first])
            if len(first) == len(rows):
                break
            parent = np.repeat(rows[first], np.diff(np.r_[first, len(rows)]))
            rest = np.ones(len(rows), bool)
            rest[first] = False
            rows, parent = rows[rest], parent[rest]
            edge = parent * 65 + np.bitwise_count(fp[rows] ^ fp[parent])
            order = np.argsort(edge, kind="stable")
            rows, group = rows[order], edge[order]
        keys, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, query: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, from the given starting nodes down."""
        waiting = [(query, node)]
        while waiting:
            query, node = waiting.pop()
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            open_ = many > 0
            query, low, many = query[open_], low[open_], many[open_]
            total = np.cumsum(many)
            at = 0
            while at < len(query):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FRONTIER, "right")))
                m = many[at:to]
                child = np.repeat(low[at:to] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                waiting.append((np.repeat(query[at:to], m), self.nodes[child]))
                at = to


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; label[x] is the smallest member known."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


def _links(chunk: pa.Table, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links within each (shard, tree, asking) of a chunk."""
    shard, tree, asking, block, fp = (chunk.column(x).to_numpy() for x in ("shard", "tree", "asking", "block", "fp"))
    fp = fp.view(np.uint64)
    new = np.r_[True, (shard[1:] != shard[:-1]) | (tree[1:] != tree[:-1]) | (asking[1:] != asking[:-1])]
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(block == tree)
    forest = Forest(fp, rows, group[rows])
    root = np.full(group[-1] + 1, -1)
    root[list(forest.roots)] = list(forest.roots.values())
    queries = np.flatnonzero((block == asking) & (root[group] >= 0))
    label = np.arange(len(fp))
    for query, node in forest.within(queries, root[group[queries]], radius):
        unite(label, query, node)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], ["u", "v"])


def _masks(blocks: int, levels: int) -> list[list[int]]:
    """For each level the blocks of bits, as signed masks: those of all bits, then for each of these those of the bits left, and so on."""
    left, out = [list(range(64))], []
    for _ in range(levels):
        parts = [[bits[len(bits) * b // blocks:len(bits) * (b + 1) // blocks] for b in range(blocks)] for bits in left]
        masks = [sum(1 << x for x in part) for each in parts for part in each]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
        left = [[x for x in bits if x not in part] for bits, each in zip(left, parts) for part in each]
    return out


def shard_members(distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """(shard, fp, trees) of distinct fingerprints ``fp``; any two within ``max_bits`` share a shard.

    ``trees`` is above one only where a shard is too large after all levels.
    """
    blocks = max_bits + 1
    zero = F.lit(0).cast("long")
    members, ready = distinct.select("fp", zero.alias("shard"), F.lit(0).alias("path")), []
    for level, masks in enumerate(_masks(blocks, levels)):
        all_masks = F.array(*[F.lit(m).cast("long") for m in masks])
        path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("path") * blocks + b))
        members = members.select("fp", "shard", path.alias("path"))
        value = F.col("fp").bitwiseAND(F.get(all_masks, F.col("path")))
        members = members.select("fp", F.xxhash64("shard", "path", value).alias("shard"), "path")
        large = members.groupBy("shard").count().where(F.col("count") > shard_rows)
        large = keep(large.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees")), "shards")
        if level == levels - 1:
            ready.append(members.join(large, "shard", "left").fillna(1, ["trees"]).select("shard", "fp", "trees"))
            break
        if large.isEmpty():
            ready.append(members.select("shard", "fp", F.lit(1).alias("trees")))
            break
        ready.append(members.join(large, "shard", "left_anti").select("shard", "fp", F.lit(1).alias("trees")))
        members = keep(members.join(large, "shard", "left_semi").select("fp", "shard", "path"), "hot")
    return reduce(DataFrame.unionByName, ready)


def link_shards(distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that connect what is linked among distinct fingerprints ``fp``."""
    members = shard_members(distinct, max_bits, shard_rows)
    members = members.select("shard", "fp", "trees", F.pmod(F.xxhash64("fp"), "trees").cast("int").alias("block"))
    # A block is a tree for itself and later blocks, and asks the trees of earlier ones.
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda o: F.struct(
        F.least(o, "block").alias("tree"), F.greatest(o, "block").alias("asking"))))
    tasks = members.select("shard", "block", "fp", pair.alias("p")).select("shard", "p.tree", "p.asking", "block", "fp")
    tasks = tasks.repartition("shard", "tree", "asking").sortWithinPartitions("shard", "tree", "asking", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK_ROWS:
                continue
            chunk = pa.Table.from_batches(held)
            keys = [chunk.column(x).to_numpy() for x in ("shard", "tree", "asking")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            end = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if end:
                yield _links(chunk.slice(0, end), max_bits)
            held, rows = chunk.slice(end).to_batches(), chunk.num_rows - end
        if rows:
            yield _links(pa.Table.from_batches(held), max_bits)

    return tasks.mapInArrow(run, "u long, v long")


def _rooted(distinct: DataFrame, max_bits: int, shard_rows: int) -> DataFrame:
    """fp, least and the component's ``root`` of distinct fingerprints (fp, least)."""
    roots = components(link_shards(distinct.select("fp"), max_bits, shard_rows))
    return distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id, text).

    Words are split at ASCII white space and lower-cased in A-Z only; a text of
    fewer words than a shingle is one shingle, and one without words (null,
    empty, blank) has fingerprint zero, which links like any other. Other
    columns are not read. Repeated rows stay rows; component_id is the smallest
    doc_id that links reach, null only where no row of the component has one.
    """
    marked = keep(fingerprints(docs, shingle_words), "fingerprints")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _rooted(distinct, max_bits, shard_rows)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The document of each component with the smallest doc_id, with all its columns.

    Rows that repeat a doc_id and its text are one document: one of them stays.
    Other texts of a doc_id are other documents, and so are those without one;
    these come after all others, and of several the one with the smallest hash stays.
    """
    marked = keep(fingerprints(docs, shingle_words), "fingerprints")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    distinct = keep(marked.groupBy("fp").agg(F.min(who).alias("least")), "distinct")
    rooted = _rooted(distinct, max_bits, SHARD_ROWS)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")
    found = keep(marked.join(named, "fp").groupBy("doc_id", "row").agg(
        F.count("*").alias("rows"), F.bool_or(who == F.col("first")).alias("stays")), "found")
    # What goes is the shorter list; while it is short, the texts need no shuffle to meet it.
    rest = without_rows(docs, keep(found.where("NOT stays").select("doc_id", "row"), "dropped"))
    row = free_name(docs, "__row")
    repeated = keep(found.where("stays AND rows > 1").select("doc_id", F.col("row").alias(row)), "repeated")
    if repeated.isEmpty():
        return rest
    again, single = split_by_ids(rest.withColumn(row, row_of()), repeated, "doc_id", row)
    return single.unionByName(again.dropDuplicates(["doc_id", row])).drop(row)
