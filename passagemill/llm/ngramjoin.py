"""Jaccard join on word n-grams by multiple-global-order filtering.

Two texts link when their sets of shingles are alike enough. Equal sets are
one class; what follows works on classes. Under any global order of tokens,
two sets that link share a token among the first few of each (their prefixes).
Three orders are used, and a pair has to pass all of them before it is
verified:

* by hash. Two sets that link share not only one token of their prefixes, but
  ``more`` of prefixes that are ``more - 1`` tokens longer. Classes with fewer
  such tokens in common with any others are out. Tasks count packed tokens, and
  a token that many classes of a task have leaves it once;
* by another hash, for the classes left: the same;
* rarest first, by a sketch of the tokens' counts over the classes left (any
  fixed order is right, so collisions cost time at most): classes that share
  a prefix token are a bucket. Candidates come from buckets, then must share
  a prefix token under the first two orders as a pair, and the sets of those
  that do are compared.

A bucket may hold any number of classes (copies with small edits, a passage
that many texts share), so its pairs are not listed. First every member meets
the pivot of its bucket; what links becomes one component. Buckets with one
component are done. In others, the members outside the pivot's component
meet all, in parts of at most about ``PART`` by ``PART`` classes: a
task passes by pairs of one component, pairs whose sizes are too far apart,
pairs that share the token before this one (they meet in its bucket), and
pairs whose parity sketches differ in more bits than their sets may differ in
tokens. Only what is left becomes a candidate. No true link between different
components is lost.

Tokens and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import components, split_by_ids, table
from passagemill.session import keep, scratch

SHINGLE_WORDS = 3
PERCENT = 90
#: Classes of a bucket that a task compares with as many others.
PART = 4096
#: Pairs that a task looks at at once, and rows that it gathers before it does.
AT_ONCE = 1 << 20
CHUNK_ROWS = 100_000
SKETCH_BITS = 1024
#: Tokens that a task merges at once, and those of a group of tokens that are counted together.
CHUNK_TOKENS = 1_000_000
GROUP_TOKENS = 2_000_000
#: Cells of the sketch of counts, in slices; tasks whose slices are added at once.
COUNT_BITS = 20
SLICES = 16
ADDED = 256
#: Odd factors make other orders of hashed tokens.
SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashed word shingles of a UTF-8 text, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    last = len(words) - width + 1
    found = {digest(joined[s:e]) for s, e in zip(starts[:last].tolist(), ends[width - 1:].tolist())}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of ``n`` of which any set that links with it has one in its own prefix."""
    return n - (percent * n + 99) // 100 + 1


def can_link(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of ``n`` may link with a different one."""
    return n > 0 and 100 * n >= percent * (n + 1)


def more_of(n: int, percent: int = PERCENT) -> int:
    """How many tokens of longer prefixes have to be shared."""
    return max(1, min(prefix_length(n, percent) // 2, (percent * n + 99) // 100))


def _reach(n: int, percent: int) -> int:
    """The length of a prefix in which the longer ones of all sets that link find as many tokens as they need."""
    return min(n, prefix_length(n, percent) - 1 + more_of(100 * n // percent, percent))


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _class_of(tokens: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def first_of(tokens: np.ndarray, count: int, factor: np.uint64 | None) -> np.ndarray:
    """The first tokens of a set (ascending) in the order of their products with ``factor``."""
    if factor is None:
        return tokens[:count]
    return tokens[np.argsort(tokens * factor)[:count]]


def sets_of(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, cls (a hash of the set, null for an empty one) and its first tokens by hash, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"", width) for t in batch.column(1).cast(pa.binary())]
            first = [x[:_reach(len(x), percent)].tobytes() if can_link(len(x), percent) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(_class_of, sets), pa.int64()), pa.array(first, pa.binary())],
                ["doc_id", "n", "cls", "first"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, cls long, first binary")


def _merged(tokens: np.ndarray, classes: np.ndarray, counts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(group, its tokens, their classes and whether they count, classes already counted) of a chunk of distinct (token, class)."""
    order = np.argsort(tokens, kind="stable")
    tokens, classes, counts = tokens[order], classes[order], counts[order]
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    many = np.repeat(np.diff(np.r_[start, len(tokens)]) > 1, np.diff(np.r_[start, len(tokens)]))
    lead = np.zeros(len(tokens), bool)
    lead[start] = True
    found = classes[many & (counts == 1)]
    # A token that several classes have is sent once, as such.
    counts = np.where(many, 2, counts).astype(np.uint8)
    tokens, classes, counts = tokens[lead], classes[lead], counts[lead]
    group, to = ((x % np.uint64(groups)).astype(np.int64) for x in (tokens, found.view(np.uint64)))
    order, local = np.argsort(group, kind="stable"), np.argsort(to, kind="stable")
    group, to = group[order], to[local]
    names = np.union1d(group, to)
    edges, cuts = ((np.searchsorted(x, names), np.searchsorted(x, names, "right")) for x in (group, to))
    for n, k in enumerate(names.tolist()):
        some, mine = order[edges[0][n]:edges[1][n]], local[cuts[0][n]:cuts[1][n]]
        yield k, tokens[some].tobytes(), classes[some].tobytes(), counts[some].tobytes(), found[mine].tobytes()


def _sharing(prefixes: DataFrame, percent: int) -> DataFrame:
    """Classes (cls) of ``prefixes`` (cls, n, first) that have as many tokens in common with others as links need."""
    total = prefixes.agg(F.coalesce(F.sum(F.octet_length("first")), F.lit(0))).first()[0] // 8
    groups = max(2 * prefixes.sparkSession.sparkContext.defaultParallelism, -(-total // GROUP_TOKENS))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_merged(*map(np.concatenate, zip(*held)), groups)))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["grp", "tokens", "classes", "counts", "found"])

        for batch in batches:
            for cls, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if cls in seen:
                    continue
                seen.add(cls)
                own = _tokens(blob.as_py())
                counts = (np.arange(len(own)) < prefix_length(n, percent) - 1 + more_of(n, percent)).astype(np.uint8)
                held.append((own, np.full(len(own), cls, np.int64), counts))
                size += len(own)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        tokens, classes, counts, found = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), t)
            for c, t in (("tokens", np.uint64), ("classes", np.int64), ("counts", np.uint8), ("found", np.int64)))
        # Copies in several tasks are one class; of a token, marks of several classes come last.
        several = counts == 2
        order = np.lexsort((classes, several, tokens))
        tokens, classes, counts, several = tokens[order], classes[order], counts[order], several[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
        other = new | np.r_[True, classes[1:] != classes[:-1]] if len(tokens) else new
        start = np.flatnonzero(new)
        shared = (np.add.reduceat(other & ~several, start) > 1) | np.logical_or.reduceat(several, start) if len(start) else new
        size = np.diff(np.r_[start, len(tokens)]) if len(start) else np.zeros(0, np.int64)
        here = classes[np.repeat(shared, size) & other & (counts == 1)] if len(start) else classes
        names, many = np.unique(np.r_[here, found], return_counts=True)
        return pa.table({"cls": pa.array(names, pa.int64()), "shared": pa.array(many, pa.int64())})

    rows = prefixes.select("cls", "n", "first").mapInArrow(chunks, "grp int, tokens binary, classes binary, counts binary, found binary")
    counted = rows.groupBy("grp").applyInArrow(count, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))
    need = F.expr(f"({percent} * n + 99) div 100")
    more = F.greatest(F.lit(1), F.least(F.expr(f"(n - ({percent} * n + 99) div 100 + 1) div 2"), need))
    sizes = prefixes.groupBy("cls").agg(F.max("n").alias("n"))
    return keep(counted.join(sizes, "cls").where(F.col("shared") >= more).select("cls"), "sharing")


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in ``SKETCH_BITS`` cells; two sets differ in as many tokens as sketches in bits, or more."""
    cells = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def _active(docs: DataFrame, left: DataFrame, classes: DataFrame, width: int, percent: int, work: str) -> DataFrame:
    """One row (cls, n, tokens, one, two, sketch) for each class of ``left`` that passes the second order; one and two are its prefixes.

    A table below ``work``; the sets that it is made from are removed again.
    """
    # Of a class the text with its smallest id is read again; other texts with that id are not of the classes left.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = keep(classes.join(left, "cls", "left_semi").select(F.col("least").alias("doc_id")).distinct(), "ids")
    texts = split_by_ids(texts, ids, "doc_id")[0]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py() or b"", width) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(map(_class_of, own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["cls", "tokens"])

    with scratch(docs.sparkSession, "read") as read_at:
        read = texts.mapInArrow(whole, "cls long, tokens binary")
        read = keep(split_by_ids(read, left, "cls")[0], "read", f"{read_at}/sets")
        several = keep(read.groupBy("cls").count().where("count > 1").select("cls"), "several")
        # Rows that share an id may have been read for one another; the sets of such classes alone are moved.
        again, once = split_by_ids(read, several, "cls")
        return _prefixed(once.unionByName(again.groupBy("cls").agg(F.first("tokens").alias("tokens"))), percent, read_at, work)


def _prefixed(sets: DataFrame, percent: int, read_at: str, work: str) -> DataFrame:
    """What ``_active`` returns, of ``sets`` (cls, tokens)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_tokens(x.as_py()) for x in batch.column(1)]
            first = [first_of(x, _reach(len(x), percent), SECOND).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, own), pa.int64()), pa.array(first, pa.binary())], ["cls", "n", "first"])

    left = _sharing(keep(sets.mapInArrow(prefixes, "cls long, n long, first binary"), "prefixes", f"{read_at}/prefixes"), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_tokens(x.as_py()) for x in batch.column(1)]
            some = [[first_of(x, prefix_length(len(x), percent), f).tobytes() for x in own] for f in (None, SECOND)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, own), pa.int64()), batch.column(1),
                 *(pa.array(x, pa.binary()) for x in (*some, [_sketch(x) for x in own]))], ["cls", "n", "tokens", "one", "two", "sketch"])

    left = split_by_ids(sets, left, "cls")[0]
    return keep(left.select("cls", "tokens").mapInArrow(run, "cls long, n long, tokens binary, one binary, two binary, sketch binary"), "active", f"{work}/active")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * THIRD) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count_sketch(active: DataFrame) -> np.ndarray:
    """For each cell of a sketch, the binary order of the count of its tokens over all classes of ``active``.

    A task makes one row for each slice of the sketch, and they are added in
    two steps, so that neither a task nor the driver holds many of them.
    """
    width = (1 << COUNT_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                np.add.at(total, _cells(_tokens(blob.as_py())), 1)
        part = TaskContext.get().partitionId() // ADDED
        rows = [zlib.compress(total[k * width:(k + 1) * width].tobytes(), 1) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(rows, pa.binary())],
                                         ["slice", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in group.column("counts"))
        return pa.table({"slice": group.column("slice").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    slices = active.select("tokens").mapInArrow(count, "slice int, part int, counts binary")
    added = slices.groupBy("slice", "part").applyInArrow(add, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    out = np.zeros(1 << COUNT_BITS, np.int64)
    # As many rows as slices.
    for row in added.collect():
        out[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return np.frexp(out.astype(np.float64))[1].astype(np.uint8)


def _buckets(active: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n, before) of the prefixes under rarest-first order, without tokens of one class; ``before`` is the class's token before."""
    sketch = _count_sketch(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lengths = [np.zeros(0, np.uint64)], []
            for blob in batch.column(2):
                own = _tokens(blob.as_py())
                first = np.lexsort((own * THIRD, sketch[_cells(own)]))[:prefix_length(len(own), percent)]
                tokens.append(own[first])
                lengths.append(len(first))
            place = np.concatenate([np.arange(x) for x in lengths]) if lengths else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.repeat(batch.column(c).to_numpy(), lengths)) for c in (0, 1)),
                 pa.array(place, pa.int32())], ["token", "cls", "n", "place"])

    with scratch(active.sparkSession, "postings") as path:
        postings = keep(active.select("cls", "n", "tokens").mapInArrow(run, "token long, cls long, n long, place int"), "postings", path)
        shared = postings.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1").select("token")
        shared = split_by_ids(postings, keep(shared, "shared"), "token")[0]
        before = F.lag("token").over(Window.partitionBy("cls").orderBy("place"))
        return keep(shared.select("token", "cls", "n", before.alias("before")), "buckets")


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pivot_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each bucket's members and its pivot, the first of its classes by hash."""
    ends = buckets.groupBy("token").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "n")).alias("p"))
    pairs = buckets.select("token", "cls", "n").join(ends, "token")
    pairs = pairs.where((F.col("cls") != F.col("p.cls")) & _near_sizes(F.col("n"), F.col("p.n"), percent))
    return pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()


def _with_both(pairs: DataFrame, active: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b; a written table) with ``columns`` of both classes; only classes of pairs are moved."""
    paired = keep(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "paired")
    active = split_by_ids(active.select("cls", *columns), paired, "cls")[0]
    for side in ("a", "b"):
        other = active.select(F.col("cls").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        pairs = pairs.join(other, side)
    return pairs


def verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under both hash orders, and then link by their sets.

    Pairs whose sketches are too far apart are left out first, as their short rows cost least to move.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("a_sketch", "b_sketch"))
            n = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            good = (100 + percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - percent) * n
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("a_one", "b_one", "a_two", "b_two")]
            good = [all(np.isin(*map(_tokens, (x.as_py(), y.as_py()))).any() for x, y in ((a, b), (c, d))) for a, b, c, d in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_tokens"), batch.column("b_tokens")):
                x, y = _tokens(x.as_py()), _tokens(y.as_py())
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = keep(_with_both(pairs, active, "n", "sketch").mapInArrow(near, "a long, b long"), "near")
    shared = _with_both(pairs, active, "one", "two").mapInArrow(share, "a long, b long")
    return _with_both(keep(shared, "candidates"), active, "tokens").mapInArrow(compare, "a long, b long")


def _compared(cls, n, label, before, sketch, other, asks, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates among the members of a part of a bucket: who ``asks``, and the others."""
    members, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    step = max(1, AT_ONCE // max(1, len(members)))
    for at in range(0, len(asking), step):
        q, m = asking[at:at + step, None], members[None, :]
        pairs = (label[q] != label[m]) & (100 * np.minimum(n[q], n[m]) >= percent * np.maximum(n[q], n[m]))
        pairs &= (before[q] != before[m]) | (before[q] == 0)
        # Two that both ask meet twice.
        pairs &= ~other[m] | (cls[q] < cls[m])
        a, b = np.nonzero(pairs)
        a, b = asking[at + a], members[b]
        for k in range(0, len(a), AT_ONCE // 16):
            x, y = a[k:k + AT_ONCE // 16], b[k:k + AT_ONCE // 16]
            bits = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
            good = (100 + percent) * bits <= (100 - percent) * (n[x] + n[y])
            yield cls[x[good]], cls[y[good]]


def _rest_pairs(buckets: DataFrame, active: DataFrame, roots: DataFrame, percent: int, part: int) -> DataFrame:
    """(a, b) of members of a bucket that are not yet in one component and may link."""
    labels = roots.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    named = keep(buckets.join(labels, "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root"), "labelled")
    # The group of the pivot is taken as the bucket's main one; any choice is right.
    main = F.min(F.struct(F.xxhash64("cls").alias("h"), "label"))["label"]
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), main.alias("main")).where("low < high")
    open_ = named.join(mixed.select("token", "main"), "token").withColumn("other", F.col("label") != F.col("main"))
    open_ = keep(open_.drop("main"), "open")
    blocks = open_.groupBy("token").agg(
        F.ceil(F.count("*") / part).cast("int").alias("parts"), F.ceil(F.count_if("other") / part).cast("int").alias("askers"))
    sketches = active.select("cls", "sketch")
    rows = open_.join(blocks, "token").join(sketches, "cls")
    own, ask = F.pmod(F.xxhash64("cls"), "parts").cast("int"), F.pmod(F.xxhash64("cls", F.lit(1)), "askers").cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda k: F.struct(own.alias("part"), k.alias("ask"), F.lit(False).alias("asks")))
    as_asker = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("part"), ask.alias("ask"), F.lit(True).alias("asks")))
    roles = F.explode(F.when(F.col("other"), F.concat(as_member, as_asker)).otherwise(as_member))
    rows = rows.select("token", "cls", "n", "label", F.coalesce("before", F.lit(0)).alias("before"), "sketch", "other", roles.alias("r")) \
        .select("token", "r.part", "r.ask", "cls", "n", "label", "before", "sketch", "other", "r.asks")
    rows = rows.repartition("token", "part", "ask").sortWithinPartitions("token", "part", "ask")

    def found(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        token, part_, ask_, cls, n, label, before = (chunk.column(c).to_numpy() for c in ("token", "part", "ask", "cls", "n", "label", "before"))
        sketch = np.frombuffer(b"".join(chunk.column("sketch").to_pylist()), np.uint64).reshape(len(cls), -1)
        other, asks = (chunk.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("other", "asks"))
        new = (token[1:] != token[:-1]) | (part_[1:] != part_[:-1]) | (ask_[1:] != ask_[:-1])
        edges = np.flatnonzero(np.r_[True, new, True])
        for s, e in zip(edges[:-1], edges[1:]):
            for a, b in _compared(cls[s:e], n[s:e], label[s:e], before[s:e], sketch[s:e], other[s:e], asks[s:e], percent):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_ = [], 0
        for batch in batches:
            held.append(batch)
            rows_ += batch.num_rows
            if rows_ < CHUNK_ROWS:
                continue
            chunk = pa.Table.from_batches(held)
            keys = [chunk.column(c).to_numpy() for c in ("token", "part", "ask")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            end = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if end:
                yield from found(chunk.slice(0, end))
            held, rows_ = chunk.slice(end).to_batches(), chunk.num_rows - end
        if rows_:
            yield from found(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def links(active: DataFrame, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """(u, v) for each class u of ``active`` that links with others: v is the smallest class reachable, itself left out."""
    buckets = _buckets(active, percent)
    first = keep(_pivot_pairs(buckets, percent), "pairs")
    linked = keep(verified(first, active, percent), "linked")
    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges)
    rest = keep(_rest_pairs(buckets, active, roots, percent, part).join(first, ["a", "b"], "left_anti"), "pairs")
    more = keep(verified(rest, active, percent), "linked")
    if more.isEmpty():
        return roots
    return components(roots.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def similar_documents(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Rows link where 100 times the shingles they share are at least ``percent``
    times those they have together. Words are split at ASCII white space and
    lower-cased in A-Z only; a text of fewer words than a shingle is one
    shingle. One without words (null, empty, blank) has none and links with
    nothing, not even its like: it is a component of its own, named by its own
    id. component_id is the smallest doc_id that links reach, null only
    where no row of the component has one. Repeated rows stay rows; other
    columns are not read; an empty table gives no row.
    """
    with scratch(docs.sparkSession, "prefixes") as path:
        marked = keep(sets_of(docs, width, percent), "prefixes", path)
        sets = keep(marked.drop("first"), "sets")
        left = _sharing(marked.where(f"cls IS NOT NULL AND 100 * n >= {percent} * (n + 1)"), percent)
    classes = keep(sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least")), "classes")
    with scratch(docs.sparkSession, "active") as work:
        roots = links(_active(docs, left, classes, width, percent, work), percent, part)
    rooted = keep(classes.join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
                  .select("cls", "least", F.coalesce("root", "cls").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    linked = rows.where("cls IS NOT NULL").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle sets that are 90 % alike."""
    return similar_documents(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS MATERIALIZED (
  SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]) END)) AS s FROM texts
), classes AS MATERIALIZED (
  SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS MATERIALIZED (
  SELECT c, n, t FROM (SELECT c, n, unnest(s) AS t FROM classes) QUALIFY count(*) OVER (PARTITION BY t) > 1
), pairs AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
  SELECT a AS c, min(least) AS component_id FROM reach JOIN classes ON b = c GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM sets s LEFT JOIN classes k ON s.s = k.s LEFT JOIN named USING (c)
"""
