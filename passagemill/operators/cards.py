"""Text cards that describe a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import row_to_text
from passagemill.settings import (
    CARD_COLUMNS, CARD_PREVIEW, CARD_ROW, CARD_ROWS, CARD_TITLE, CELL_JOIN, MISSING_CELL, PREVIEW_ROWS,
)
from passagemill.sources.csvfiles import RANGE_BYTES, summarise_csv


def preview_rows(df: DataFrame, order_by, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in file order, numbered from 1 in ``row_no``."""
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    # The limit is a top-n without a full sort; numbering sees n rows only.
    head = df.orderBy(*columns).limit(n)
    rows = head.agg(F.array_sort(F.collect_list(F.struct(*columns, F.struct(*df.columns).alias("__row")))).alias("rows"))
    return rows.select(F.posexplode("rows")).select(
        (F.col("pos") + 1).cast("long").alias("row_no"), *[F.col("col.__row")[name].alias(name) for name in df.columns]
    )


def table_card(df: DataFrame, name: str, order_by, n: int = PREVIEW_ROWS) -> DataFrame:
    """One row (name, content) describing ``df``: columns, size, first rows."""
    before, after = CARD_ROW.split("{number}")
    lines = preview_rows(df, order_by, n).select(
        "row_no",
        F.concat(F.lit(before), F.col("row_no").cast("string"), F.lit(after), row_to_text(df.columns)).alias("line"),
        F.lit(0).cast("long").alias("n_rows"),
    )
    size = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(0).cast("long").alias("row_no"), F.lit(None).cast("string").alias("line"), "n_rows"
    )
    both = lines.unionByName(size).agg(
        F.sum("n_rows").alias("n_rows"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("row_no", "line")))), lambda r: r["line"]).alias("lines"),
    )
    heading = [F.lit(f"{CARD_TITLE}{name}"), F.lit(f"{CARD_COLUMNS}{', '.join(df.columns)}")]
    content = F.concat_ws(
        "\n", *heading, F.concat(F.lit(CARD_ROWS), F.col("n_rows").cast("string")),
        F.lit(CARD_PREVIEW), F.col("lines"),
    )
    return both.select(F.lit(name).alias("name"), content.alias("content"))


def _cell(value, kind: str) -> str:
    if value is None:
        return MISSING_CELL
    if kind in ("small", "int", "unsigned"):
        return str(int(value))
    if kind == "float":
        return str(float(value))
    if kind == "bool":
        return value.capitalize()
    return value


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cards = []
        for row in batch.itertuples(index=False):
            if row.header is None:
                cards.append("")
                continue
            lines = [
                f"{CARD_TITLE}{row.path.rsplit('/', 1)[-1]}",
                f"{CARD_COLUMNS}{', '.join(row.header)}",
                f"{CARD_ROWS}{row.n_rows}",
                CARD_PREVIEW,
            ]
            for number, cells in enumerate(row.preview, 1):
                shown = [f"{n}: {_cell(c, k)}" for n, c, k in zip(row.header, cells, row.kinds)]
                lines.append(CARD_ROW.format(number=number) + CELL_JOIN.join(shown))
            cards.append("\n".join(lines))
        yield pd.DataFrame({"path": batch["path"], "content": cards})


def csv_cards(files: DataFrame, n: int = PREVIEW_ROWS, sep: str | None = None, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length) of table files -> (path, content); unreadable gives ''."""
    return summarise_csv(files, n, sep, split_bytes).mapInPandas(_render, "path string, content string")
