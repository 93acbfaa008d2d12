"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens, and pieces are dealt
by hash into shards of bounded size. Of each shard, several islands evolve a
population of packings side by side. Crossover injects whole well-filled bins
of one parent into the other, removes the bins that hold the same pieces again,
and places the displaced pieces by best fit, longest first. After each epoch
the best packing of an island migrates to the next island of its shard. An
island rests once it has as few bins as the total length allows; the farther it
is from that, the more generations it has. The first packing is best fit. Where
it leaves a gap, others join it that pack the longest pieces among themselves
and balance the rest: the longest with the shortest, and what fits best between.

Bins that a shard could not fill are dissolved, and their pieces are packed
anew, together with those of other shards, as long as that saves bins or until
one shard is left. Shards, islands and levels are rows of tables in the shared
folder.
"""

from __future__ import annotations

import math
import os
import random
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import table
from passagemill.session import keep

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, on average.
SHARD_PIECES = 4096
ISLANDS, EPOCHS, POPULATION = 2, 2, 6
#: Generations of an epoch: so many, and one for each so many bins of the gap, up to so many.
GENERATIONS, GAP_BINS, MOST_GENERATIONS = 8, 4, 40
#: Shares of the longest pieces that the first packings keep to themselves.
CUTS = tuple(n / 40 for n in range(21))
#: A level that saves less than this share of the bins is the last.
GAIN = 0.002
#: A bin filled to less than this share is dissolved for the next level.
FILLED = 0.98
TAIL = b".,!?;:$%&*#"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Word (UTF-8, no ASCII white space) to its ids as little-endian bytes.

    White space is dropped before words are looked up in the vocabulary, so a
    text's ids are those of its words. A word is put together from a stem in
    lower case and trailing ASCII punctuation where that gives the same ids.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        # How a byte-level vocabulary writes bytes: printable ones as they are, others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.bytes = {b: 256 + n for n, b in enumerate(others)}
        self.pieces: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> None:
        """Words of letters in lower case are one piece of the vocabulary's model, so
        that they can go to it directly; others take the tokenizer's whole way."""
        rest = []
        for word in words:
            text = word.decode()
            if text.isalpha() and text == text.lower() and (word.isascii() or is_normalized("NFC", text)):
                ids = [t.id for t in self.model.tokenize(text if word.isascii() else word.decode("latin-1").translate(self.bytes))]
                self.pieces[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(word)
        if rest:
            found = self.encoder.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            for word, e in zip(rest, found):
                self.pieces[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(TAIL)
        if not stem or not stem[-1:].isalnum():
            return word, b""
        return stem.lower() if stem.isascii() and b"|" not in stem else stem, word[len(stem):]

    def of(self, words: list[bytes]) -> bytes:
        if len(self) > 500_000:
            self.clear()
            self.pieces.clear()
        new = [w for w in set(words) if w not in self]
        if new:
            split = {w: self.parts(w) for w in new}
            missing = {p for parts in split.values() for p in parts if p and p not in self.pieces}
            if missing:
                self.encode(list(missing))
            for word, (stem, tail) in split.items():
                self[word] = self.pieces[stem] + self.pieces[tail] if tail else self.pieces[stem]
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each row.

    A document is the ids of its text and an end id; only a longer one than
    ``capacity`` is cut. ``ordinal`` tells repeated rows apart.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ordinal = _word_ids(path), 0
        end = struct.pack("<I", END_ID)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = encoder.of((text.as_py() or b"").split()) + end
                ordinal += 1
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc_id, ordinal, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "ordinal", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, ordinal long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class Packing:
    """Pieces in bins; the fewer bins, and then the more uneven, the better."""

    def __init__(self, bins: list[list[int]], free: list[int], capacity: int):
        self.bins, self.free = bins, free
        self.fitness = (-len(bins), sum(((capacity - f) / capacity) ** 2 for f in free))

    @staticmethod
    def of(assigned: np.ndarray, lengths: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1)]
        for piece, b in enumerate(assigned.tolist()):
            bins[b].append(piece)
        return Packing(bins, [capacity - sum(lengths[p] for p in b) for b in bins], capacity)

    def assigned(self, pieces: int) -> np.ndarray:
        out = np.zeros(pieces, np.int32)
        for b, members in enumerate(self.bins):
            out[members] = b
        return out


def best_fit(pieces: list[int], lengths: list[int], capacity: int, bins: list[list[int]], free: list[int]) -> Packing:
    """Place each piece, in the given order, in the bin that it fills best."""
    room = sorted((f, b) for b, f in enumerate(free) if f)
    for piece in pieces:
        need = lengths[piece]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
            left -= need
            bins[b].append(piece)
            free[b] = left
        else:
            b, left = len(bins), capacity - need
            bins.append([piece])
            free.append(left)
        if left:
            insort(room, (left, b))
    return Packing(bins, free, capacity)


def balanced(cut: float, lengths: list[int], capacity: int) -> Packing:
    """The longest pieces (a share of ``cut``) by best fit; a bin of the rest takes the
    longest piece, as many of the shortest as an even share allows, and the best fits."""
    order = sorted(range(len(lengths)), key=lambda p: -lengths[p])
    many = int(cut * len(order))
    top = best_fit(order[:many], lengths, capacity, [], [])
    bins, free = top.bins, top.free
    rest = sorted((lengths[p], p) for p in order[many:])
    if rest:
        share = max(2, round(capacity * len(rest) / max(1, sum(n for n, _ in rest))))
    while rest:
        need, piece = rest.pop()
        members, left = [piece], capacity - need
        for _ in range(share - 2):
            if rest and rest[0][0] <= left:
                need, piece = rest.pop(0)
                members.append(piece)
                left -= need
        while at := bisect_left(rest, (left + 1, -1)):
            need, piece = rest.pop(at - 1)
            members.append(piece)
            left -= need
        bins.append(members)
        free.append(left)
    return Packing(bins, free, capacity)


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """b's best-filled bins go into a; what they displace is placed by best fit."""
    full = sorted(range(len(b.bins)), key=b.free.__getitem__)
    many = rng.randint(1, max(1, len(full) // 3))
    start = rng.randint(0, max(0, len(full) // 2 - many))
    injected = full[start:start + many]
    held = {p for n in injected for p in b.bins[n]}
    bins, free, displaced = [list(b.bins[n]) for n in injected], [b.free[n] for n in injected], []
    for members, room in zip(a.bins, a.free):
        if held.isdisjoint(members):
            bins.append(list(members))
            free.append(room)
        else:
            displaced += [p for p in members if p not in held]
    displaced.sort(key=lambda p: (-lengths[p], p))
    return best_fit(displaced, lengths, capacity, bins, free)


def evolve(lengths: list[int], capacity: int, population: list[Packing], rng: random.Random) -> list[Packing]:
    """An epoch of an island; the best comes first."""
    order = list(range(len(lengths)))
    if not population:
        population.append(best_fit(sorted(order, key=lambda p: -lengths[p]), lengths, capacity, [], []))
    least = math.ceil(sum(lengths) / capacity)
    gap = -population[0].fitness[0] - least
    if gap > 0:
        if len(population) < POPULATION:
            first = sorted((balanced(cut, lengths, capacity) for cut in CUTS), key=lambda p: p.fitness, reverse=True)
            population += first[:POPULATION - 2]
        while len(population) < POPULATION:
            rough = sorted(order, key=lambda p: -lengths[p] * rng.uniform(0.8, 1.2))
            population.append(best_fit(rough, lengths, capacity, [], []))
        population.sort(key=lambda p: p.fitness, reverse=True)
        gap = -population[0].fitness[0] - least
        for _ in range(min(MOST_GENERATIONS, GENERATIONS + gap // GAP_BINS)):
            if -population[0].fitness[0] == least:
                break
            a, b = rng.sample(range(len(population)), 2)
            for x, y in ((a, b), (b, a)):
                population.append(crossover(population[x], population[y], lengths, capacity, rng))
            population.sort(key=lambda p: p.fitness, reverse=True)
            del population[POPULATION:]
    return sorted(population, key=lambda p: p.fitness, reverse=True)


ISLAND = "shard long, island int, lengths array<int>, packings array<binary>, bins int, fitness double"


def _epoch(islands: DataFrame, epoch: int, capacity: int, seed: int) -> DataFrame:
    """Every island (shard, island, lengths, packings, migrant) after one more epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = random.Random(f"{seed} {row['shard']} {row['island']} {epoch}")
                lengths = row["lengths"]
                packings = [*([row["migrant"]] if row["migrant"] else []), *(row["packings"] or [])]
                population = [Packing.of(np.frombuffer(p, np.int32), lengths, capacity) for p in dict.fromkeys(packings)]
                population.sort(key=lambda p: p.fitness, reverse=True)
                best = evolve(lengths, capacity, population, rng)
                yield pa.RecordBatch.from_pylist([{
                    "shard": row["shard"], "island": row["island"], "lengths": lengths,
                    "packings": [p.assigned(len(lengths)).tobytes() for p in best],
                    "bins": len(best[0].bins), "fitness": best[0].fitness[1]}], schema=pa.schema([
                        ("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())),
                        ("packings", pa.list_(pa.binary())), ("bins", pa.int32()), ("fitness", pa.float64())]))

    return islands.mapInArrow(run, ISLAND)


def _pack_shards(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and ``filled`` (tokens in the sequence)."""
    shard = F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece", "ordinal"), F.lit(shards)).alias("shard")
    member = F.struct((-F.col("length")).alias("order"), *pieces.columns)
    members = keep(pieces.select(shard, member.alias("m")).groupBy("shard").agg(F.array_sort(F.collect_list("m")).alias("members")), "members")
    islands = members.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.transform("members", lambda m: m["length"].cast("int")).alias("lengths"),
        F.lit(None).cast("array<binary>").alias("packings"), F.lit(None).cast("binary").alias("migrant"))
    islands = islands.repartition(max(1, min(shards * ISLANDS, 4 * pieces.sparkSession.sparkContext.defaultParallelism, 2000)
                                      if shards < 10_000 else shards // 4), "shard", "island")
    for epoch in range(EPOCHS):
        state = keep(_epoch(islands, epoch, capacity, level), "islands")
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("packings", F.lit(0)).alias("migrant"))
        islands = state.drop("bins", "fitness").join(elite, ["shard", "island"])
    best = state.groupBy("shard").agg(F.min_by(F.get("packings", F.lit(0)), F.struct("bins", -F.col("fitness"), "island")).alias("packing"))
    fields = [f.name for f in pieces.schema.fields]
    out = pa.schema([(n, pa.int32() if n == "piece" else pa.list_(pa.int32()) if n == "ids" else pa.int64())
                     for n in [*fields, "sequence_id", "offset", "filled"]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                shard, packing = batch.column(0)[n].as_py(), np.frombuffer(batch.column(2)[n].as_py(), np.int32)
                rows = batch.column(1)[n].values
                lengths = rows.field("length").to_numpy(zero_copy_only=False)
                order = np.argsort(packing, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.flatnonzero(np.r_[True, np.diff(packing[order]) != 0])
                sizes = np.diff(np.r_[first, len(order)])
                begins = ends - lengths[order]
                offset, filled = np.zeros(len(order), np.int64), np.bincount(packing, lengths).astype(np.int64)
                offset[order] = begins - np.repeat(begins[first], sizes)
                # 8 bits for the level, 31 for the shard and 24 for the bin: a shard has far fewer pieces.
                sequence = (level << 55) + (shard << 24) + packing.astype(np.int64)
                arrays = [rows.field(f).cast(out.field(f).type) for f in fields]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset), pa.array(filled[packing])], schema=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return members.join(best, "shard").select("shard", "members", "packing") \
        .mapInArrow(place, f"{kinds}, sequence_id long, offset long, filled long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) and their places in sequences.

    doc_id, piece, start, length, ids_crc32 (ids too, if asked for), sequence_id
    and offset. A null or empty text is its end id alone; repeated rows are
    packed like any others. An empty table has no pieces. Other columns are not
    read, whatever their names.
    """
    pieces = keep(cut_pieces(docs, tokenizer, capacity, with_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    done, level, count, before = [], 0, pieces.count(), None
    while True:
        shards = max(1, math.ceil(count / shard_pieces))
        placed = keep(_pack_shards(pieces, shards, level, capacity), "placed")
        short = F.col("filled") < FILLED * capacity
        bins, poor, left = placed.agg(
            F.count_distinct("sequence_id"), F.count_distinct(F.when(short, F.col("sequence_id"))), F.count_if(short)).first()
        if before is not None and bins >= before[1]:
            # Nothing saved: the pieces stay where they were.
            done.append(before[0].select(columns))
            break
        if shards == 1 or not left or before is not None and bins > (1 - GAIN) * before[1]:
            done.append(placed.select(columns))
            break
        done.append(placed.where(~short).select(columns))
        before = placed.where(short), poor
        pieces, count, level = before[0].drop("sequence_id", "offset", "filled"), left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))
