"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; the rows of a language are a tree, and the roots of the
languages' trees are the leaves of one more. A node is the hash of up to two
nodes, a lone last one is hashed by itself, and a tree ends with one node.

Leaves are numbered by a range-partitioned sort and dealt into aligned blocks
of ``2 ** BLOCK_BITS``. A task appends a block's leaves one by one. It holds
the roots of the open subtrees, of falling heights, and the partial witness of
each leaf; when a sibling of the same height completes, both subtrees' leaves
have their witnesses extended by the other's root, and the two become one open
subtree. The roots of blocks are appended the same way in blocks of their own,
and so on until a tree has one node; what that adds to a block's witness is
added to those of its leaves by a join of one row a block. No task holds more
than a block, and the driver holds nothing but the number of tiers.

A witness is a text of sides, one for each level (``R``: the sibling stands to
the right, ``L``: to the left, ``-``: none), and the siblings' digests.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_BYTES, table
from passagemill.session import keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_BITS = 10
#: Rows are tampered with where this divides the checksum of their id.
TAMPERED = 7


def digest_of(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(node.hex() for node in nodes).encode()).digest()


class Appender:
    """A tree that grows leaf by leaf, with the witness of each leaf so far."""

    def __init__(self):
        self.sides: list[str] = []
        self.proofs: list[bytearray] = []
        #: (height, first leaf, root) of the open subtrees, of falling heights.
        self.open: list[tuple[int, int, bytes]] = []

    def _extend(self, first: int, end: int, side: str, sibling: bytes = b"") -> None:
        for n in range(first, end):
            self.sides[n] += side
            self.proofs[n] += sibling

    def _close(self) -> None:
        """The last two open subtrees, of one height, become one."""
        height, right, right_root = self.open.pop()
        _, left, left_root = self.open.pop()
        self._extend(left, right, "R", right_root)
        self._extend(right, len(self.sides), "L", left_root)
        self.open.append((height + 1, left, digest_of(left_root, right_root)))

    def append(self, digest: bytes) -> None:
        self.open.append((0, len(self.sides), digest))
        self.sides.append("")
        self.proofs.append(bytearray())
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._close()

    def finish(self, height: int = 0) -> bytes:
        """The root of all leaves, once nothing more comes; of a tree of ``height`` at least."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._close()
            else:
                level, first, root = self.open.pop()
                self._extend(first, len(self.sides), "-")
                self.open.append((level + 1, first, digest_of(root)))
        return self.open[0][2]


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    return reduce(Column.__and__, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys))


def _meet(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """Each row with what ``few`` (one row for each ``keys``, a written table) has for it; nulls are equal.

    ``few`` is broadcast only while it is small.
    """
    size = few.agg(F.count("*"), F.coalesce(F.max(sum((F.octet_length(c) for c, t in few.dtypes if t in ("string", "binary")), F.lit(0))), F.lit(0))).first()
    other = few.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in few.columns))
    if size[0] * (size[1] + 64) <= BROADCAST_BYTES:
        other = F.broadcast(other)
    return rows.join(other, _same(rows, other, *keys), "left").drop(*(f"__{k}" for k in keys))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (a written table) with their place ``at`` in their group, from 0, and the group's ``total``.

    A range-partitioned sort and the counts of its partitions; a group may be
    of any size, and rows that are equal in ``order`` are dealt out, too.
    """
    keys = [group, *order, "__row"]
    sorted_ = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    # The id counts within a partition from its 33rd bit up.
    placed = keep(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("part", F.shiftright("__id", 33)).withColumn("__id", F.col("__id").bitwiseAND((1 << 33) - 1))
    # One row for each partition and group in it.
    counts = placed.groupBy("part", group).agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    all_ = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keep(counts.select("part", group, (before - F.col("__low")).alias("__shift"), F.sum("__n").over(all_).alias("total")), "counts")
    return _meet(placed, counts, "part", group).withColumn("at", F.col("__id") + F.col("__shift")).drop("part", "__id", "__shift")


def _blocks(nodes: DataFrame, group: str, bits: int) -> DataFrame:
    """``nodes`` (``group``, at, total, digest and more) with the witness in their
    block; ``block_root`` stands in a block's first row."""
    fields = nodes.drop("at").columns
    schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in fields)

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        tree = Appender()
        for digest in block.column("digest").to_pylist():
            tree.append(digest)
        # A block of a larger tree is as high as all its blocks.
        root = tree.finish(bits if block.column("total")[0].as_py() > 1 << bits else 0)
        added = [pa.array(tree.sides, pa.string()), pa.array(map(bytes, tree.proofs), pa.binary()),
                 pa.array([root] + [None] * (len(tree.sides) - 1), pa.binary())]
        return pa.table([*(block.column(c) for c in fields), block.column("block"), *added], [*fields, "block", "sides", "proof", "block_root"])

    dealt = nodes.withColumn("block", F.shiftright("at", bits))
    return keep(dealt.groupBy(group, "block").applyInArrow(run, f"{schema}, block long, sides string, proof binary, block_root binary"), "blocks")


def grow(nodes: DataFrame, group: str, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """The trees over ``nodes`` (``group``, at, total, digest and more; at from 0).

    Returns the nodes with ``block`` and, in ``sides`` and ``proof``, the
    witness in their block, and a row for each block: ``group``, block,
    up_sides, up_proof (from the block's root on) and tree_root.
    """
    first = _blocks(nodes, group, bits)
    tiers = [first]
    while True:
        roots = tiers[-1].where("block_root IS NOT NULL").select(
            group, F.col("block").alias("at"), F.shiftright(F.col("total") + ((1 << bits) - 1), bits).alias("total"), F.col("block_root").alias("digest"))
        if (roots.agg(F.max("total")).first()[0] or 0) <= 1:
            break
        # A tree that has one node by now ends; others go on.
        tiers.append(_blocks(roots.withColumn("node", F.col("at")), group, bits))
    # From the last tier down: what comes after a block's root, and the root of its tree.
    up = roots.select(group, F.col("at").alias("block"), F.lit("").alias("up_sides"), F.lit(b"").alias("up_proof"), F.col("digest").alias("tree_root"))
    for tier in reversed(tiers[1:]):
        up = _meet(tier, keep(up, "up"), group, "block").select(
            group, F.col("node").alias("block"), F.concat("sides", "up_sides").alias("up_sides"), F.concat("proof", "up_proof").alias("up_proof"), "tree_root")
    return first, keep(up, "up")


def encoded(value: Column) -> Column:
    """A field of a leaf: its bytes, counted, or a dash for a null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             carried: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """``order``, ``group``, leaf, subroot, root, sides and proof (the witness) of every row of ``docs``.

    Digests are binary. A leaf hashes the ``fields``; a null has an encoding of
    its own, an empty text another. A group's rows stand by ``order``, null
    first, then by leaf, so repeated rows have places of their own. Groups are in bytewise
    order, null first. An empty table has no row. Other columns are not read;
    ``carried`` are columns of ``docs`` that come along under their names.
    """
    leaves = keep(docs.select(F.col(order).alias("key"), F.col(group).cast("string").alias("tree"), leaf_of(*map(F.col, fields)).alias("digest"),
                              *(c.alias(f"carried_{n}") for n, c in (carried or {}).items())), "leaves")
    rows, up = grow(numbered(leaves, "tree", "key", "digest"), "tree", bits)
    # The trees' roots are the leaves of one more.
    trees = keep(up.where("block = 0").select(F.lit(0).alias("top"), "tree", F.col("tree_root").alias("digest")), "trees")
    named, above = grow(numbered(trees, "top", "tree"), "top", bits)
    named = _meet(named.select("top", "tree", "block", "sides", "proof"), above, "top", "block").select(
        "tree", F.concat("sides", "up_sides").alias("top_sides"), F.concat("proof", "up_proof").alias("top_proof"), F.col("tree_root").alias("root"))
    up = _meet(up, keep(named, "tops"), "tree").select(
        "tree", "block", F.col("tree_root").alias("subroot"), "root", F.concat("up_sides", "top_sides").alias("up_sides"),
        F.concat("up_proof", "top_proof").alias("up_proof"))
    return _meet(rows, keep(up, "up"), "tree", "block").select(
        F.col("key").alias(order), F.col("tree").alias(group), F.col("digest").alias("leaf"), "subroot", "root",
        F.concat("sides", "up_sides").alias("sides"), F.concat("proof", "up_proof").alias("proof"),
        *(F.col(f"carried_{n}").alias(n) for n in (carried or {})))


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def folded(leaf: Column, sides: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its witness; all digests as hex text."""
    level = F.transform(F.split(sides, ""), lambda s: s)
    start = F.struct(leaf.alias("node"), F.lit(1).alias("at"))

    def step(state: Column, side: Column) -> Column:
        sibling = F.substring(proof, state["at"], F.lit(64))
        joined = F.when(side == "R", F.concat(state["node"], sibling)).when(side == "L", F.concat(sibling, state["node"])).otherwise(state["node"])
        return F.struct(F.sha2(joined, 256).alias("node"), F.when(side == "-", state["at"]).otherwise(state["at"] + 64).alias("at"))

    return F.aggregate(F.filter(level, lambda s: s != ""), start, step, lambda s: s["node"])


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and whether a tampered copy of it passes.

    Tampering adds 1 to n_chars, which may then need more than 64 bits; a null
    stays, and a row without an id is not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    forged = F.when(hit & F.col("n_chars").isNotNull(), leaf_of(*(more if c == "n_chars" else F.col(c) for c in FIELDS)))
    rows = manifest(docs, carried={"forged": forged})
    rows = rows.select(
        "doc_id", _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), "sides", _hex("proof").alias("proof"),
        _hex("forged").alias("forged"))
    folded_root = folded(F.coalesce("forged", "leaf"), F.col("sides"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded_root.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE coded AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, source, n_chars, text,
         CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                      lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) END AS crc
  FROM documents
), parts AS (
  SELECT row, doc_id, lang, crc, n_chars,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM coded
), hashed AS (
  SELECT row, doc_id, coalesce('=' || lang, '-') AS tree, lang,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-'
                             ELSE strlen((n_chars::HUGEINT + coalesce((crc % 7 = 0)::INTEGER, 0))::VARCHAR)
                                  || ':' || (n_chars::HUGEINT + coalesce((crc % 7 = 0)::INTEGER, 0)) END || tail) AS forged
  FROM parts
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), node AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM node WHERE n > 1 GROUP BY tree, lvl, place // 2, n
), nodes AS MATERIALIZED (SELECT * FROM node
), subroots AS MATERIALIZED (
  SELECT tree, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree) WHERE n = 1
), top AS (
  SELECT 0 AS lvl, place, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY lvl, place // 2, n
), tops AS MATERIALIZED (SELECT * FROM top
), walk AS (
  SELECT row, tree, 0 AS lvl, place, n, forged AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT w.row, w.tree, w.lvl + 1, w.place // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.place IS NULL THEN w.folded WHEN s.place < w.place THEN s.digest || w.folded ELSE w.folded || s.digest END),
         w.proof || coalesce(s.digest, '')
  FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.lvl = w.lvl AND s.place = xor(w.place, 1) WHERE w.n > 1
), climb AS (
  SELECT row, 0 AS lvl, s.place, s.n, folded, proof FROM walk w JOIN subroots s USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT w.row, w.lvl + 1, w.place // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.place IS NULL THEN w.folded WHEN s.place < w.place THEN s.digest || w.folded ELSE w.folded || s.digest END),
         w.proof || coalesce(s.digest, '')
  FROM climb w LEFT JOIN tops s ON s.lvl = w.lvl AND s.place = xor(w.place, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN (SELECT digest FROM tops WHERE n = 1) t ON true JOIN (SELECT * FROM climb WHERE n = 1) c USING (row)
"""
