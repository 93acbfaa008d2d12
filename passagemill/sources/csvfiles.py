"""Comma- and tab-separated files.

One tokeniser reads every file, whatever its size and name. A file is read in
byte ranges, each by a task: a first look counts the quotes of every range, so
that each knows whether it begins inside a quoted cell, and a range reads the
records that begin in it. What the ranges found is put together by file. A
file in which quotes stand where that rule would be misled (each range checks
its own records) is read again in order by one task, with the same tokeniser.

A byte that is no UTF-8, or a record with more cells than the first ones have,
makes the whole file unreadable, wherever it stands. Cards of files and rows
of files (``summarise_csv``, ``scan_csv``) come from the same ranges and rules.
"""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.session import keep
from passagemill.sources.rawfiles import list_files, open_filesystem

log = logging.getLogger(__name__)

RANGE_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
BATCH_RECORDS = 4096
CELLS = pa.list_(pa.string())
SUMMARY = (
    "path string, header array<string>, preview array<array<string>>, "
    "kinds array<string>, n_rows long, lead int"
)
#: What a range has: its first cells, how many cells its records have, and for
#: each place whether all present cells are whole numbers (of 64 bits, with or
#: without a sign), numbers, or truth values.
FOUND = (
    "path string, start long, first array<array<string>>, n_rows long, first_cells int, most_cells int, "
    "flags array<array<boolean>>, bad boolean, odd boolean"
)

# Cell texts the data-frame library reads as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
ABSENT = frozenset(MISSING)
INTEGER = re.compile(r"\s*[+-]?[0-9]+\s*", re.A)
NUMBER = re.compile(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", re.A)
BOOLEAN = re.compile(r"True|TRUE|true|False|FALSE|false")
WHOLE, SIGNED, UNSIGNED, REAL, TRUTH, SMALL = range(6)
LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)")


def separator(path: str, sep: str | None = None) -> str:
    return sep or ("\t" if path.lower().endswith(".tsv") else ",")


class _Lines:
    """Lines of a file from a place on, decoded; counts what has been taken."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.buffer, self.place, self.ended = stream, at, b"", 0, False
        self.quotes, self.within, self.odd = 0, False, False

    def _more(self) -> None:
        block = self.stream.read(BLOCK_BYTES)
        self.ended = not block
        self.buffer, self.place = self.buffer[self.place:] + block, 0

    def raw(self) -> bytes:
        while True:
            found = LINE.match(self.buffer, self.place)
            # A line that ends with the buffer may go on with a line feed.
            if found and (found.end() < len(self.buffer) or self.ended or found[0].endswith(b"\n")):
                line = found[0]
            elif self.ended:
                line = self.buffer[self.place:]
            else:
                self._more()
                continue
            self.place += len(line)
            self.at += len(line)
            return line

    def __iter__(self) -> Iterator[str]:
        return self

    def __next__(self) -> str:
        start, line = self.at, self.raw()
        if not line:
            raise StopIteration
        # A record's second line has to begin within quotes by their count.
        self.odd |= self.within and self.quotes % 2 == 0
        self.within = True
        self.quotes += line.count(b'"')
        text = line.decode("utf-8")
        return text.removeprefix("﻿") if start == 0 else text

    def records(self, sep: str, end: int | None) -> Iterator[list[str]]:
        """Records that begin before ``end``."""
        reader = csv.reader(self, delimiter=sep)
        while end is None or self.at < end:
            self.quotes, self.within = 0, False
            record = next(reader, None)
            if record is None:
                return
            self.odd |= self.quotes % 2 == 1
            if record and (len(record) > 1 or record[0].strip(" \t")):
                yield record


def _skip_to_record(stream, start: int, quoted: bool) -> _Lines:
    """Lines from the first record that begins at ``start`` or after it."""
    stream.seek(start - 1)
    lines = _Lines(stream, start - 1)
    before = stream.read(1)
    if not quoted and before == b"\n":
        lines.at = start
        return lines
    if before == b"\r" and not quoted:
        after = stream.read(1)
        lines.buffer, lines.at = after, start
        if after != b"\n":
            return lines
        lines.buffer, lines.at = b"", start + 1
        return lines
    lines.at = start
    while line := lines.raw():
        quoted ^= line.count(b'"') % 2 == 1
        if not quoted:
            break
    return lines


def _flags_of(cell: str, flags: list[bool]) -> None:
    if flags[WHOLE] or flags[REAL]:
        whole = INTEGER.fullmatch(cell)
        if whole:
            value = int(cell) if len(cell) < 40 else 1 << 64
            flags[SMALL] = flags[SMALL] and -(1 << 31) <= value < 1 << 31
            flags[SIGNED] = flags[SIGNED] and -(1 << 63) <= value < 1 << 63
            flags[UNSIGNED] = flags[UNSIGNED] and 0 <= value < 1 << 64
        else:
            flags[WHOLE] = False
            flags[REAL] = flags[REAL] and bool(NUMBER.fullmatch(cell))
    flags[TRUTH] = flags[TRUTH] and bool(BOOLEAN.fullmatch(cell))


@contextmanager
def _open_range(path: str, sep: str, start: int, end: int | None, quoted: bool) -> Iterator[tuple[_Lines, list[str] | None, Iterator[list[str]]]]:
    """The lines of a range, the header if it begins the file, and its other records."""
    csv.field_size_limit(1 << 30)
    filesystem, inner = open_filesystem(path)
    with filesystem.open_input_file(inner) as stream:
        lines = _Lines(stream, 0) if start == 0 else _skip_to_record(stream, start, quoted)
        records = lines.records(sep, end)
        header = next(records, None) if start == 0 else None
        if start == 0 and header is None:
            raise ValueError("no header")
        yield lines, header, records


def _read_range(path: str, sep: str, start: int, end: int | None, quoted: bool, rows: int) -> tuple:
    first, flags, n_rows, first_cells, most = [], [], 0, None, 0
    with _open_range(path, sep, start, end, quoted) as (lines, header, records):
        if header is not None:
            first.append(header)
        for record in records:
            n_rows += 1
            if first_cells is None:
                first_cells = len(record)
            most = max(most, len(record))
            if len(first) < rows + (start == 0):
                first.append(record)
            while len(flags) < len(record):
                flags.append([True] * 6)
            for cell, own in zip(record, flags):
                if cell not in ABSENT and (own[WHOLE] or own[REAL] or own[TRUTH]):
                    _flags_of(cell, own)
    return path, start, first, n_rows, first_cells, most, flags, False, lines.odd


COLUMNS = [part.split()[0] for part in FOUND.split(", ")]


def _read_ranges(rows: int, sep: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end, quoted in batch[["path", "start", "end", "quoted"]].itertuples(index=False):
                try:
                    found = _read_range(path, separator(path, sep), int(start), None if pd.isna(end) else int(end), bool(quoted), rows)
                except (OSError, ValueError, csv.Error) as error:
                    log.warning("could not read table %s: %s", path, error)
                    found = (path, start, [], 0, None, 0, [], True, False)
                yield pd.DataFrame([found], columns=COLUMNS)

    return run


def _count_quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = []
        for path, start, end in batch[["path", "start", "end"]].itertuples(index=False):
            total = 0
            try:
                filesystem, inner = open_filesystem(path)
                with filesystem.open_input_file(inner) as stream:
                    stream.seek(int(start))
                    left = (1 << 62) if pd.isna(end) else int(end) - int(start)
                    while left and (block := stream.read(min(left, BLOCK_BYTES))):
                        total += block.count(b'"')
                        left -= len(block)
            except OSError as error:
                log.warning("could not read table %s: %s", path, error)
            counts.append(total)
        yield batch[["path", "start", "end", "length"]].assign(quotes=counts)


def _names(header: list[str]) -> list[str]:
    """Column names as the data-frame library gives them: none empty, none twice."""
    names, counts = [], {}
    for n, name in enumerate(header):
        name = base = name or f"Unnamed: {n}"
        while counts.get(name, 0):
            counts[base] += 1
            name = f"{base}.{counts[base] - 1}"
        counts[name] = counts.get(name, 0) + 1
        names.append(name)
    return names


def _kind(flags: list[bool]) -> str:
    if flags[WHOLE]:
        return "small" if flags[SMALL] else "int" if flags[SIGNED] else "unsigned" if flags[UNSIGNED] else "text"
    return "float" if flags[REAL] else "bool" if flags[TRUTH] else "text"


def _merge(rows: int):
    def run(found: pd.DataFrame) -> pd.DataFrame:
        """All ranges of one file; they are as many as its length has ranges."""
        found = found.sort_values("start")
        path = found["path"].iloc[0]
        unreadable = pd.DataFrame([(path, None, None, None, 0, 0)], columns=[p.split()[0] for p in SUMMARY.split(", ")])
        if found["bad"].any() or found["start"].iloc[0] != 0:
            return unreadable
        parts = [list(map(list, x)) for x in found["first"]]
        header, parts[0] = _names(parts[0][0]), parts[0][1:]
        firsts = found["first_cells"].dropna()
        # Where the first record has more cells than the header, the surplus leads as row labels.
        lead = max(0, int(firsts.iloc[0]) - len(header)) if len(firsts) else 0
        if found["most_cells"].max() > len(header) + lead:
            return unreadable
        flags = [[True] * 6 for _ in header]
        for one in found["flags"]:
            for own, more in zip(flags, list(one)[lead:]):
                own[:] = [a and bool(b) for a, b in zip(own, more)]
        preview = [r[lead:] + [""] * (len(header) + lead - len(r)) for part in parts for r in part][:rows]
        preview = [[None if c in ABSENT else c for c in r[:len(header)]] for r in preview]
        return pd.DataFrame([(path, header, preview, [_kind(f) for f in flags], int(found["n_rows"].sum()), lead)],
                            columns=[p.split()[0] for p in SUMMARY.split(", ")])

    return run


def _ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, length) -> (path, start, end, length, quoted): what tasks read, and whether it begins within quotes."""
    files = files.select("path", F.coalesce("length", F.lit(0)).alias("length"))
    last = F.greatest(F.floor((F.col("length") - 1) / split_bytes), F.lit(0)).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"), last.alias("last"))
    ranges = ranges.select(
        "path", (F.col("n") * split_bytes).alias("start"), F.when(F.col("n") < F.col("last"), (F.col("n") + 1) * split_bytes).alias("end"),
        F.least("length", F.lit(split_bytes)).cast("long").alias("length"))
    # A file of one range begins outside quotes and need not be looked at first.
    several = _deal(ranges.where("start > 0 OR end IS NOT NULL")).mapInPandas(_count_quotes, "path string, start long, end long, length long, quotes long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    several = several.withColumn("quoted", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False))).drop("quotes")
    return ranges.where("start = 0 AND end IS NULL").withColumn("quoted", F.lit(False)).unionByName(several)


def _whole(paths: DataFrame) -> DataFrame:
    """Files as one range each."""
    return paths.select("path", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("quoted"))


def _found(ranges: DataFrame, preview_rows: int, sep: str | None) -> tuple[DataFrame, DataFrame]:
    """What ranges have, and the files (path) that had to be read in order."""
    found = keep(_deal(ranges).mapInPandas(_read_ranges(preview_rows, sep), FOUND), "tables")
    misled = found.groupBy("path").agg(F.bool_or("odd").alias("odd"), F.count("*").alias("n")).where("odd AND n > 1").select("path")
    again = _whole(misled).mapInPandas(_read_ranges(preview_rows, sep), FOUND)
    return found.join(misled, "path", "left_anti").unionByName(again), misled


def summarise_csv(files: DataFrame, preview_rows: int, sep: str | None = None, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length) -> header, first rows, column kinds and row count per file.

    ``split_bytes`` is what a task reads at once; results do not depend on it.
    """
    return _found(_ranges(files, split_bytes), preview_rows, sep)[0].groupBy("path").applyInPandas(_merge(preview_rows), SUMMARY)


#: Types of columns, by the kinds that their cells have in the files, "small" being "int" in 32 bits; a column without cells is taken as whole numbers.
TYPES = {frozenset(["int"]): "long", frozenset(["unsigned"]): "decimal(20,0)", frozenset(["int", "unsigned"]): "decimal(20,0)",
         frozenset(["float"]): "double", frozenset(["int", "float"]): "double", frozenset(["bool"]): "boolean"}


def _type(kinds: list[str]) -> str:
    """The type of a column that has cells of these kinds."""
    return "int" if set(kinds) == {"small"} else TYPES.get(frozenset("int" if kind == "small" else kind for kind in kinds), "string")


def _files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of files, and of files below folders."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        filesystem, inner = open_filesystem(path)
        info = filesystem.get_file_info(inner)
        one = spark.createDataFrame([(path, info.size)], "path string, length long") if info.is_file else \
            list_files(spark, path).where(r"path RLIKE '(?i)\\.(csv|tsv)$' AND path NOT RLIKE '/\\.[^/]*$'")
        out = one if out is None else out.unionByName(one)
    return out


def scan_csv(spark: SparkSession, paths: str | list[str], sep: str | None = None, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of files that share a header, typed, with their file in ``source_path``.

    ``paths`` are files, or folders whose visible ``.csv`` and ``.tsv`` files
    are read. A file that ``csv_cards`` cannot read has no row here, either, and
    is logged; missing cells are null, row labels before the first column are
    left out, and files with another header than the rest are an error. A
    column has the type that the cells of all files have.
    """
    ranges = keep(_ranges(_files_of(spark, paths), split_bytes), "ranges")
    found, misled = _found(ranges, 0, sep)
    tables = keep(found.groupBy("path").applyInPandas(_merge(0), SUMMARY), "summaries").where("header IS NOT NULL")
    headers = tables.select("header").distinct().limit(2).collect()
    if not headers:
        return spark.createDataFrame([], "source_path string")
    if len(headers) > 1:
        raise ValueError(f"files have different headers: {headers[0][0]} and {headers[1][0]}")
    names = headers[0][0]
    kinds = tables.where("n_rows > 0").select(F.posexplode("kinds").alias("place", "kind")).groupBy("place").agg(F.collect_set("kind").alias("kinds"))
    types = {r.place: _type(r.kinds) for r in kinds.collect()}
    good = tables.select("path", "lead")
    read = ranges.drop("length").join(misled, "path", "left_anti").unionByName(_whole(misled)).join(good, "path")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                with _open_range(row["path"], separator(row["path"], sep), row["start"], row["end"], row["quoted"]) as (_, _, rest):
                    for record in rest:
                        held.append([None if cell in ABSENT else cell for cell in record[row["lead"]:]])
                        if len(held) == BATCH_RECORDS:
                            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(held)), pa.array(held, CELLS)], ["path", "cells"])
                            held = []
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(held), pa.string()), pa.array(held, CELLS)], ["path", "cells"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-ranges.count() // 4))
    rows = read.repartition(tasks, "path", "start").mapInArrow(records, "path string, cells array<string>")
    columns = [F.get("cells", F.lit(n)).cast(types.get(n, "string")).alias(name) for n, name in enumerate(names)]
    return rows.select(*columns, F.col("path").alias("source_path"))


def _deal(ranges: DataFrame) -> DataFrame:
    """Ranges spread over the tasks; those of one file go apart."""
    total = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * RANGE_BYTES)))
    return ranges.repartition(tasks, "path", "start")
