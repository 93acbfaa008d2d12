"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of a text are replaced by typed placeholders, so that
a question and the same question with other parameters have one template.
Windows of template tokens are hashed; those of the documents meet those of
the benchmark in a hash join. Matches of one document and item line up on a
diagonal (the difference of their positions), and there the slots must be
consistent: whatever stands in the document for a slot's value in the item
must be the same wherever that value occurs in the stretch. A document holds an
item if ``run`` consecutive tokens, or all of a shorter item, match that way.
What is a name does not depend on a passage's surroundings: windows with all
capitalised words as names, and with none, meet as well. A template's window is
evidence only if enough of it are words that this template leaves as they are.
Windows of the words themselves meet, too, and need no such share.

An item of fewer than ``WINDOW`` tokens has no template; its own words must
match. One of ``SHORT_TOKENS`` tokens and ``SHORT_CHARS`` letters and digits
counts anywhere, one of fewer tokens as a line or sentence of its own, and one
of fewer letters only if the whole text is nothing else.

Documents' windows pass a bitmap of the benchmark's hashes first, which has
room for ``BITMAP_ROOM`` bits a window and takes 16 MB at most; what passes it
by chance ends in the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import row_of, table, without_rows
from passagemill.llm.substrings import rolling
from passagemill.session import keep

WINDOW = 8
#: Tokens in a row that must match; a shorter item must match whole.
RUN = 13
#: A window with fewer literal tokens than this share is evidence only with the very values of its slots.
LITERALS = 0.5
#: What an item without a whole window needs, so that common words hold nothing.
SHORT_TOKENS = 4
SHORT_CHARS = 12
#: Marks on the hashes of windows that are a line or sentence, or a text, of their own.
AS_LINE, AS_TEXT = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)
BITMAP_ROOM = 64
BITMAP_BITS = range(16, 28)

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’„‚«»‹›¿¡…–—·•"
NUMBER = re.compile(r"[+-]?\d[\d.,:/'^-]*")
MEASURE = re.compile(r"[+-]?\d[\d.,]*[a-zµ°]{1,4}")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNIT_WORDS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles metre metres meter meters centimetre centimetres centimeter centimeters "
    "kilometre kilometres kilometer kilometers mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs "
    "ml l litre litres liter liters gallon gallons pint pints cup cups second seconds sec minute minutes min hour hours h hr hrs day days week "
    "weeks month months year years cent cents dollar dollars euro euros percent degree degrees watt watts volt volts amp amps joule joules "
    "calorie calories newton newtons mph kmh bit bits byte bytes kb mb gb tb".split())
ENDS = frozenset(".!?:;")
SKIP, LITERAL, NUMBER_KIND, UNIT, TITLE, MEASURE_KIND = range(6)
PLACEHOLDERS = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in ("number", "unit", "name", "measure")}


class Tokens(dict):
    """What words are, remembered for the words of late: eight bytes, a hash of the
    folded word, whose lowest bits give way to its kind and whether it ends a sentence.

    Words of the time before are looked up once more, so that common ones are not worked out again.
    """

    SIZE = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        value = self[word] = self.before.get(word) or self._looked_at(word)
        return value

    @staticmethod
    def _looked_at(word: str) -> bytes:
        plain = word.isalpha()
        core = word if plain else word.strip(EDGES)
        low = core.lower()
        letters = plain or core.isalpha()
        if not core:
            kind = SKIP
        elif low in NUMBER_WORDS or not letters and NUMBER.fullmatch(core):
            kind = NUMBER_KIND
        elif not letters and MEASURE.fullmatch(low):
            kind = MEASURE_KIND
        elif low in UNIT_WORDS:
            kind = UNIT
        else:
            kind = TITLE if not core.islower() and len(core) > 1 and core[0].isupper() and core[1:].islower() else LITERAL
        ends = not plain and word.rstrip("\"'”’»)")[-1:] in ENDS
        return (xxhash.xxh64_intdigest(low) & ~15 | kind | ends << 3).to_bytes(8, "little")

    def template(self, text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """The text's templates, each with what is a slot in it, the tokens' own hashes, and where lines and sentences start."""
        if len(self) > self.SIZE:
            self.before = dict(self)
            self.clear()
        lines = [words for line in text.split("\n") if (words := line.split())]
        found = np.frombuffer(b"".join(map(self.__getitem__, chain.from_iterable(lines))), "<u8").astype(np.uint64, copy=False)
        return self._resolve(found & np.uint64(~15 & (1 << 64) - 1), found & np.uint64(7), (found & np.uint64(8)) > 0, lines)

    @staticmethod
    def _resolve(own, kind, ends, lines) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        # Where a line starts, or a sentence after a word that ends one.
        first = np.zeros(len(own) + 1, bool)
        first[1:] = ends
        first[0] = True
        first[np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))] = True
        used = kind != SKIP
        if used.all():
            start = first[:-1]
        else:
            # A word of punctuation alone passes on that a sentence starts.
            begun = np.cumsum(first[:-1])[used]
            own, kind = own[used], kind[used]
            start = np.ones(len(own), bool)
            start[1:] = begun[1:] > begun[:-1]
        values = own.copy()
        title = kind == TITLE
        value = ~title & (kind != LITERAL)
        if value.any():
            number = kind == NUMBER_KIND
            values[number] = PLACEHOLDERS["number"]
            unit = kind == UNIT
            unit[0] = False
            unit[1:] &= number[:-1]
            values[unit] = PLACEHOLDERS["unit"]
            measure = kind == MEASURE_KIND
            values[measure] = PLACEHOLDERS["measure"]
            value = number | unit | measure
        # A sentence's first word is a name if it is one inside a sentence, too.
        name = title & ~start
        if name.any():
            name |= title & np.isin(own, own[name])
        # What surrounds a passage has a say in that; it has none where all such words are names, or no words are.
        kinds = [name, *([title] if (title & ~name).any() else []), *([np.zeros_like(name)] if name.any() else [])]
        return [(np.where(k, PLACEHOLDERS["name"], values), value | k) for k in kinds], own, start


def _whole_windows(templates: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, wanted_of) -> Iterator[tuple]:
    """Hashes of the windows, which of them to take, and what is a slot, for the words themselves and each template.

    ``wanted_of`` says which are wanted at all; one that is taken is not taken again.
    """
    earlier: list[tuple[np.ndarray, np.ndarray]] = []
    for template, slot in [(own, np.zeros(len(own), bool)), *templates]:
        hashes = rolling(template, WINDOW) ^ np.uint64(WINDOW)
        wanted = wanted_of(hashes, slot)
        if wanted.any():
            for h, taken in earlier:
                wanted &= ~taken | (hashes != h)
            earlier.append((hashes, wanted))
            yield hashes, wanted, slot


def _evident(hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which of an item's windows have enough words that are no slots."""
    slots = np.r_[0, np.cumsum(slot)]
    return WINDOW - (slots[WINDOW:] - slots[:-WINDOW]) >= LITERALS * WINDOW


def _short_windows(own: np.ndarray, start: np.ndarray, width: int, chars: int | None) -> Iterator[tuple]:
    """The same for windows of the words themselves that are shorter; ``chars`` is an item's."""
    hashes, none = rolling(own, width) ^ np.uint64(width), np.zeros(len(own), bool)
    every = np.ones(len(hashes), bool)
    if chars is not None:
        mark = AS_TEXT if chars < SHORT_CHARS else AS_LINE if width < SHORT_TOKENS else np.uint64(0)
        yield hashes ^ mark, every, none
        return
    yield hashes, every, none
    alone = start[:len(hashes)].copy()
    alone[:-1] &= start[width:]
    yield hashes ^ AS_LINE, alone, none
    yield hashes ^ AS_TEXT, every & (len(own) == width), none


WINDOW_ROWS = "id long, row long, tokens int, at int, width int, hash long, slots array<struct<at:int,value:long>>, fixed array<struct<at:int,value:long>>"
PLACES = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())]))
ARROW_ROWS = pa.schema([
    ("id", pa.int64()), ("row", pa.int64()), ("tokens", pa.int32()), ("at", pa.int32()), ("width", pa.int32()), ("hash", pa.int64()),
    ("slots", PLACES), ("fixed", PLACES)])


def template_windows(texts: DataFrame, widths: list[int] | None, bitmap: bytes | None = None) -> DataFrame:
    """Template windows of ``texts`` (id, row, text), with the slots in them.

    Without ``widths`` a text is an item and has the windows of its own width:
    WINDOW, or all its tokens if it has fewer. ``fixed`` are then its slots that
    a window's template holds as they are. ``bitmap`` lets through what may be wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        shift = np.uint64(0 if bits is None else 65 - len(bits).bit_length())

        def known(hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
            return np.ones(len(hashes), bool) if bits is None else bits[(hashes >> shift).astype(np.int64)]

        for batch in batches:
            out = []
            for n, (id_, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = batch.column(2)[n].as_py() or ""
                templates, own, start = tokens.template(text)
                chars = sum(map(str.isalnum, text)) if widths is None else None

                def places(which: np.ndarray, at: int, width: int) -> list[dict]:
                    return [{"at": k, "value": int(own[at + k].view(np.int64))} for k in np.flatnonzero(which[at:at + width]).tolist()]

                for width in widths or [min(WINDOW, len(own))]:
                    if not width or len(own) < width:
                        continue
                    found = _whole_windows(templates, own, known if widths else _evident) if width == WINDOW else _short_windows(own, start, width, chars)
                    for hashes, wanted, slot in found:
                        if width < WINDOW:
                            wanted = wanted & known(hashes, slot)
                        fixed = templates[0][1] & ~slot if widths is None else np.zeros(len(own), bool)
                        for at in np.flatnonzero(wanted).tolist():
                            out.append((id_, row, len(own), at, width, int(hashes[at].view(np.int64)), places(slot, at, width), places(fixed, at, width)))
            columns = list(zip(*out)) or [()] * len(ARROW_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_ROWS)], schema=ARROW_ROWS)

    return texts.mapInArrow(run, WINDOW_ROWS)


def _bitmap(items: DataFrame) -> bytes:
    """The first bits of the items' window hashes as a bitmap that has room for them, within bounds."""
    bits = min(max((BITMAP_ROOM * items.count()).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[-1])
    place = F.shiftrightunsigned("hash", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = items.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def _longest_run(places: Column) -> Column:
    """The most consecutive numbers in an ascending array."""
    state = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, at: Column) -> Column:
        run = F.when(at == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(at.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(places, state, step, lambda s: s["best"])


def _stretch(places: list[int], width: int, values: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """Tokens, distinct slots and changed ones of the longest stretch of a diagonal that is matched and consistent.

    ``places`` are the matched windows, ascending, and ``values`` the values in
    item and document of each slot's place. Of stretches as long, the one with
    the fewest changes is returned.
    """
    best = (0, 0, 0)
    begin = 0
    for end in range(1, len(places) + 1):
        if end < len(places) and places[end] == places[end - 1] + 1:
            continue
        left, last = places[begin], places[end - 1] + width
        begin = end
        # Of each slot's value in the item: the one it has in the document, and where it was last.
        seen: dict[int, tuple[int, int]] = {}
        cuts = []
        for at in range(left, last):
            if at in values:
                item, doc = values[at]
                if item in seen and seen[item][0] != doc and seen[item][1] >= left:
                    cuts.append((left, at))
                    left = seen[item][1] + 1
                seen[item] = doc, at
        for a, b in [*cuts, (left, last)]:
            if b - a >= best[0]:
                pairs = {values[at] for at in range(a, b) if at in values}
                best = max(best, (b - a, -sum(i != d for i, d in pairs), len(pairs)))
    return best[0], best[2], -best[1]


def _stretches(lined: DataFrame) -> DataFrame:
    """doc_id, row, item_id, item_tokens, matched_tokens, n_slots and n_changed of each diagonal."""
    keys = ["doc_id", "row", "item_id", "item_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places, width, values in zip(*(batch.column(x) for x in ("places", "width", "values"))):
                found.append(_stretch(places.as_py(), width.as_py(), {v["at"]: (v["item"], v["doc"]) for v in values.as_py()}))
            columns = [pa.array([f[k] for f in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, "matched_tokens", "n_slots", "n_changed"])

    return lined.select(*keys, "places", "width", "values").mapInArrow(
        run, "doc_id long, row long, item_id long, item_tokens int, matched_tokens int, n_slots int, n_changed int")


def _held(docs: DataFrame, benchmark: DataFrame, run: int) -> DataFrame:
    """The stretches of each text (doc_id, row) that count for an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    items = keep(template_windows(items.dropDuplicates(["id", "row"]), None), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), row_of().alias("row"), F.col("text").cast("string").alias("text"))
    found = template_windows(texts, widths or [WINDOW], _bitmap(items))
    item = items.select(
        F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("tokens").alias("item_tokens"), "hash", F.col("at").alias("item_at"),
        F.col("slots").alias("item_slots"), "fixed")
    pairs = found.select(F.col("id").alias("doc_id"), "row", "at", "width", "hash", "slots").join(item, "hash")
    values = F.concat(
        F.zip_with("item_slots", "slots", lambda i, d: F.struct((F.col("item_at") + i["at"]).alias("at"), i["value"].alias("item"), d["value"].alias("doc"))),
        F.transform("fixed", lambda i: F.struct((F.col("item_at") + i["at"]).alias("at"), i["value"].alias("item"), i["value"].alias("doc"))))
    keys = ["doc_id", "row", "item_id", "item_row", "item_tokens", "width"]
    lined = pairs.groupBy(*keys, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.array_sort(F.collect_set("item_at")).alias("places"), F.array_distinct(F.flatten(F.collect_list(values))).alias("values"))
    least = F.least("item_tokens", F.lit(run))
    return _stretches(lined.where(_longest_run(F.col("places")) + F.col("width") - 1 >= least)).where(F.col("matched_tokens") >= least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id, item_tokens, matched_tokens, n_slots, n_changed for each
    item that a document holds; n_changed counts slots with another value.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are not read. Null and empty texts, and texts of punctuation alone, hold
    nothing and are in nothing; short items are held as said above. Rows
    that repeat doc_id and text, or an item, count once; of rows that share only
    the doc_id each is judged, and the best match is returned.
    """
    held = _held(docs, benchmark, run)
    best = F.max(F.struct("matched_tokens", (-F.col("n_changed")).alias("same"), "n_slots", "item_tokens"))
    return held.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.item_tokens", "b.matched_tokens", "b.n_slots", (-F.col("b.same")).alias("n_changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all columns."""
    leaked = keep(_held(docs, benchmark, RUN).select("doc_id", "row").distinct(), "leaked")
    return without_rows(docs, leaked)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
