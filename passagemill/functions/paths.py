"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.settings import TEXT_NAMES, Settings


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(name: Column) -> Column:
    """Lower-cased last suffix; empty for ``.env``, ``README`` and ``a.``."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def is_extension(extension: Column, extensions) -> Column:
    return extension.isin(*extensions)


def classify_kind(name: Column, extension: Column, settings: Settings = Settings()) -> Column:
    """text, code, csv, image or other; the first match wins."""
    is_text = is_extension(extension, settings.text_extensions) | F.lower(name).isin(*TEXT_NAMES)
    return (
        F.when(is_text, "text")
        .when(is_extension(extension, settings.code_extensions), "code")
        .when(is_extension(extension, settings.csv_extensions), "csv")
        .when(is_extension(extension, settings.image_extensions), "image")
        .otherwise("other")
    )


def is_visible(name: Column) -> Column:
    """Dot files are hidden unless they end in .md or .txt (case-sensitive)."""
    return ~name.startswith(".") | name.endswith(".md") | name.endswith(".txt")
