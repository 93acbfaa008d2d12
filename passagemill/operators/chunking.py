"""Splitting documents into overlapping chunks, without a shuffle."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.settings import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def chunk_id(path: Column, chunk_no: Column) -> Column:
    return F.md5(F.concat(path, F.lit("#"), chunk_no.cast("string")))


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")


def _with_chunks(documents: DataFrame, pieces: Column, text_col: str) -> DataFrame:
    kept = [c for c in documents.columns if c != text_col]
    # The plain (not outer) form makes the optimizer add a filter on the array
    # that computes all pieces a second time.
    return (
        documents.withColumn("__pieces", pieces)
        .select(*kept, F.posexplode_outer("__pieces").alias("chunk_no", text_col))
        .where("chunk_no is not null")
        .withColumn("chunk_no", F.col("chunk_no").cast("long"))
    )


def chunk_ids(chunks: DataFrame, path_col: str = "path") -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col(path_col), F.col("chunk_no")))


def chunk_fixed(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    text_col: str = "content", path_col: str = "path",
) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` later."""
    _check(size, overlap)
    stride = size - overlap
    text = F.col(text_col)
    n_windows = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(stride)).cast("int"))
    # Cutting the text once into stride-long blocks keeps the work linear in
    # its length; a window is a run of blocks trimmed to size.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    run = -(-size // stride)

    def window(parts: Column, i: Column) -> Column:
        return F.substring(F.array_join(F.slice(parts, i, run), ""), 1, size)

    # Passing the blocks through a lambda evaluates them once per text.
    windows = F.transform(
        F.array(blocks), lambda parts: F.transform(F.sequence(F.lit(1), n_windows), lambda i: window(parts, i))
    )[0]
    return chunk_ids(_with_chunks(documents, F.when(text != "", windows), text_col), path_col)


def _cut(text: str, separator: str) -> list[str]:
    """Cut before every separator, so it opens the piece that follows it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [piece for piece in (first, *(separator + r for r in rest)) if piece]


def _pack(pieces: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def _windows(text: str, size: int, overlap: int) -> Iterator[str]:
    start = 0
    while True:
        yield text[start:start + size]
        if start + size >= len(text):
            return
        start += size - overlap


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Coarse-to-fine splitting of one text (the per-row helper)."""

    def split(part: str, levels: Sequence[str]) -> Iterator[str]:
        level = next((n for n, s in enumerate(levels) if s in part), len(levels) - 1)
        separator, finer = levels[level], levels[level + 1:]
        if not separator:
            yield from _windows(part, size, overlap)
            return
        fitting: list[str] = []
        for piece in _cut(part, separator):
            if len(piece) < size:
                fitting.append(piece)
                continue
            yield from _pack(iter(fitting), size, overlap)
            fitting = []
            if finer:
                yield from split(piece, finer)
            else:
                yield piece
        yield from _pack(iter(fitting), size, overlap)

    stripped = (chunk.strip() for chunk in split(text, separators))
    return [chunk for chunk in stripped if chunk]


def chunk_recursive(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS, text_col: str = "content", path_col: str = "path",
) -> DataFrame:
    """Chunks cut at paragraphs, else lines, else words, else characters.

    Only the text crosses to Python and only the chunks come back; metadata
    stays in the JVM, and nothing is shuffled.
    """
    _check(size, overlap)
    levels = tuple(separators)

    @F.pandas_udf("array<string>")
    def split_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, size, overlap, levels))

    return chunk_ids(_with_chunks(documents, split_batch(F.col(text_col)), text_col), path_col)
