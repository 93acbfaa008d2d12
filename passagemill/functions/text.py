"""Column functions over text: decoding, trimming, wrapping, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.settings import CELL_JOIN, CODE_HEADING, ENCODINGS, IMAGE_HEADING, MISSING_CELL, PREVIEW_CHARS, PREVIEW_TAIL

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
NON_BLANK = f"[^{WHITESPACE}]"
BYTE_ORDER_MARKS = (b"\xff\xfe", b"\xfe\xff")
OUTER_BLANKS = f"^[{WHITESPACE}]+|[{WHITESPACE}]+\\z"


def is_nonblank(text: Column) -> Column:
    return text.rlike(NON_BLANK)


def trim_blanks(text: Column) -> Column:
    """Strip every kind of whitespace (SQL ``trim`` removes spaces only)."""
    return F.regexp_replace(text, OUTER_BLANKS, "")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(content: Column) -> Column:
    """MD5 of the bytes; an unreadable file hashes to the empty string."""
    return F.coalesce(F.md5(content), F.lit(""))


def decode_bytes(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that accepts all bytes (the per-row helper).

    As when a file is opened as text, UTF-16 needs its byte order mark.
    """
    for encoding in encodings:
        if encoding == "utf-16" and not raw.startswith(BYTE_ORDER_MARKS):
            continue
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


@F.pandas_udf(T.StringType())
def _decode_fallback(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else decode_bytes(bytes(raw), ENCODINGS[1:]))


def decode_text(content: Column) -> Column:
    """UTF-8, else UTF-16, else Latin-1, with newlines normalised.

    UTF-8 is handled in the JVM. Only bytes that are not UTF-8 are sent to
    Python, whose UTF-16 rules (byte order mark required, odd lengths and lone
    surrogates rejected) the JVM decoders do not follow.
    """
    as_text = content.cast("string")
    is_utf8 = F.is_valid_utf8(as_text)
    others = F.when(~is_utf8, content)
    text = F.when(is_utf8, as_text).otherwise(_decode_fallback(others))
    return F.coalesce(normalise_newlines(text), F.lit(""))


def wrap_content(text: Column, kind: Column, extension: Column) -> Column:
    """Prefix source code always and image text only when there is some."""
    before, after = CODE_HEADING.split("{extension}")
    stripped = trim_blanks(text)
    return (
        F.when(kind == "code", F.concat(F.lit(before), extension, F.lit(after), text))
        .when(kind == "image", F.when(stripped != "", F.concat(F.lit(IMAGE_HEADING), stripped)).otherwise(""))
        .otherwise(text)
    )


def content_preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(PREVIEW_TAIL))).otherwise(text)


def row_to_text(columns: list[str]) -> Column:
    """``name: value`` pairs joined with `` | ``; nulls print ``nan``."""
    return F.concat_ws(
        CELL_JOIN,
        *[
            F.concat(F.lit(f"{name}: "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(MISSING_CELL)))
            for name in columns
        ],
    )


def render_prompt(context: Column, question: Column, template: str) -> Column:
    """Fill the first ``{context}`` and ``{question}``; other braces stay as they are."""
    slots = sorted((template.index(name), name, column) for name, column in (("{context}", context), ("{question}", question)))
    parts, at = [], 0
    for start, name, column in slots:
        parts += [F.lit(template[at:start]), column]
        at = start + len(name)
    return F.concat(*parts, F.lit(template[at:]))
