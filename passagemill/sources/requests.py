"""Questions and search requests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import is_nonblank, trim_blanks
from passagemill.schemas import REQUEST_BODY, REQUEST_NUMBERS
from passagemill.settings import FETCH_FACTOR, Settings


def read_questions(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(q_id, query) of every non-blank question, trimmed."""
    return df.where(is_nonblank(F.col(text_col))).select(
        F.col(id_col).alias("q_id"), trim_blanks(F.col(text_col)).alias("query")
    )


def parse_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Typed columns of JSON request bodies.

    Text that is not a JSON object yields no fields at all; a field of the
    wrong type is treated as absent. A count that is a number but no whole one
    of 64 bits is named in ``problem``, which ``validate_requests`` turns into
    a rejection.
    """
    read = df.withColumns({"__request": F.from_json(body_col, REQUEST_BODY), "__numbers": F.from_json(body_col, REQUEST_NUMBERS)})
    request, numbers = F.col("__request"), F.col("__numbers")
    counts, problem = {}, F.lit(None).cast("string")
    for name in reversed(REQUEST_NUMBERS.names):
        number = numbers[name]
        # 5.0 is the whole number 5.
        whole = (number == F.floor(number)) & (F.abs(number) < 2.0 ** 53)
        counts[name] = F.coalesce(request[name], F.when(whole, number.cast("long")))
        unfit = request[name].isNull() & number.isNotNull() & ~F.coalesce(whole, F.lit(False))
        problem = F.when(unfit, f"{name} is no whole number that fits").otherwise(problem)
    return read.select(
        *df.columns, *[counts.get(name, request[name]).alias(name) for name in REQUEST_BODY.names], problem.alias("problem")
    )


def resolve_search_params(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fill what the request leaves out from the settings.

    Any search type other than ``mmr`` means similarity.
    """
    present = set(requests.columns)

    def given(name: str, kind: str):
        return F.col(name) if name in present else F.lit(None).cast(kind)

    k = F.coalesce(given("k", "long"), F.lit(settings.k)).cast("long")
    # Three times a very large count is as good as the largest number.
    several = F.coalesce(F.try_multiply(k, F.lit(FETCH_FACTOR)), F.lit((1 << 63) - 1))
    fetch_k = [given("fetch_k", "long")] + ([F.lit(settings.fetch_k)] if settings.fetch_k is not None else [])
    search_type = F.coalesce(given("search_type", "string"), F.lit(settings.search_type))
    return requests.withColumns({
        "k": k,
        "search_type": F.when(search_type == "mmr", "mmr").otherwise("similarity"),
        "fetch_k": F.coalesce(*fetch_k, several).cast("long"),
        "lambda_mult": F.coalesce(given("lambda_mult", "double"), F.lit(settings.lambda_mult)),
    })
