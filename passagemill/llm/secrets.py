"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its parse tree follows a Boolean query
of trigrams that every match must contain: strings that a part can only be are
crossed together, their trigrams are required together, and alternatives are
joined by OR. The index has a posting (trigram, document) for each trigram
that a query names. Intersecting the postings gives each rule's candidates,
whose texts are then matched; a rule without mandatory trigrams is matched
against every text.

All of it is DataFrame operations. A match's place comes from two passes with
the same expression: ``split`` gives the lengths between the matches and
``regexp_extract_all`` the matches, and their running sum is the offset.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_BYTES, table
from passagemill.session import keep

#: More strings than this for one part, and it counts as unknown.
EXACT_LIMIT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further kinds that this module looks for.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (any text), or ("and" | "or", parts), a part being a trigram or a query.


def _all(parts) -> tuple | bool:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 and isinstance(parts[0], tuple) else ("and", tuple(parts))


def _any(parts) -> tuple | bool:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> tuple | bool:
    """What a text that contains one of the strings must have."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(other < s for other in sets)]
    return _any([_all(sorted(s)) for s in sorted(least, key=sorted)])


def _analyse(tree) -> tuple[set[str] | None, tuple | bool]:
    """The strings that an expression can only be (None: unknown), and the query otherwise."""
    exact, queries = {""}, []
    for op, value in tree:
        part, query = None, True
        if op is kinds.LITERAL:
            part = {chr(value).lower()} if value < 128 else None
        elif op is kinds.SUBPATTERN:
            part, query = _analyse(value[3])
        elif op is kinds.IN:
            if all(o is kinds.LITERAL and v < 128 for o, v in value):
                part = {chr(v).lower() for _, v in value}
        elif op is kinds.BRANCH:
            branches = [_analyse(b) for b in value[1]]
            if all(b[0] is not None for b in branches):
                part = set().union(*(b[0] for b in branches))
            else:
                query = _any([_of_strings(b[0]) if b[0] is not None else b[1] for b in branches])
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, body = value
            inner, inner_query = _analyse(body)
            if (low, high) == (0, 1) and inner is not None:
                part = inner | {""}
            elif low == high == 1:
                part, query = inner, inner_query
            elif low >= 1:
                query = _of_strings(inner) if inner is not None else inner_query
        elif op is kinds.AT:
            part = {""}
        if part is not None and len(part) * len(exact) <= EXACT_LIMIT:
            exact = {a + b for a in exact for b in part}
            continue
        # What was exact so far ends here; the unknown part may be followed by more.
        queries += [_of_strings(exact), _of_strings(part) if part is not None else query]
        exact = {""}
    if not queries:
        return exact, _of_strings(exact)
    return None, _all([*queries, _of_strings(exact)])


def trigram_query(pattern: str) -> tuple | bool:
    """The Boolean query of lower-case trigrams for a pattern; True if it requires none."""
    exact, query = _analyse(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return set().union(*({p} if isinstance(p, str) else _trigrams(p) for p in query[1]))


def _holds(query, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    parts = [_holds(p, found) for p in query[1]]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, key) of ``docs`` (key, text) for the given trigrams."""
    folded = docs.select("key", F.lower("text").alias("folded"))
    has = F.array_compact(F.array(*[F.when(F.col("folded").contains(t), F.lit(t)) for t in trigrams]))
    return folded.select("key", F.explode(has).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """key and the kinds whose query the postings of that key satisfy."""
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("found"))
    fits = F.array_compact(F.array(*[F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return held.select("key", fits.alias("kinds")).where(F.size("kinds") > 0)


def _matches(docs: DataFrame, rule: Rule, order: int) -> DataFrame:
    """key, rank of the kind, start and end of each match in ``docs`` (key, text)."""
    java = F.lit(rule.pattern)
    rows = docs.where(F.col("text").rlike(rule.pattern)).select(
        "key", F.split("text", rule.pattern, -1).alias("between"), F.regexp_extract_all("text", java, F.lit(0)).alias("whole"),
        F.regexp_extract_all("text", java, F.lit(rule.group)).alias("part"))
    each = F.transform("whole", lambda w, i: F.struct(
        F.length(F.get("between", i)).alias("gap"), F.length(w).alias("long"), F.length(F.get("part", i)).alias("part")))
    rows = rows.select("key", F.posexplode(each).alias("at", "m"))
    ends = F.sum(F.col("m.gap") + F.col("m.long")).over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("key", ends.alias("end"), "m").where(F.col("m.part") >= rule.least)
    return rows.select("key", F.lit(order).alias("rank"), (F.col("end") - F.col("m.long")).alias("start"), "end")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of rank, start, end, kind; by start, then rank) of every row.

    ``docs`` has doc_id and text; other columns are not read. Offsets are code
    points, the end exclusive. A null text is empty; a text without secrets has
    an empty array. Rows that repeat doc_id and text are searched once and each
    returned; rows that share only the doc_id are kept apart.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    found = [_matches(docs, r, n) for n, r in enumerate(rules) if queries[r.kind] is True]
    if indexed:
        trigrams = sorted(set().union(*map(_trigrams, indexed.values())))
        index = postings(docs, trigrams)
        fits = keep(candidates(index, indexed), "candidates")
        if fits.count() * 64 <= BROADCAST_BYTES:
            fits = F.broadcast(fits)
        likely = docs.select(F.col("key").alias("k"), "text").join(fits, F.col("k").eqNullSafe(F.col("key"))).drop("k")
        likely = keep(likely.dropDuplicates(["key"]), "likely")
        found += [_matches(likely.where(F.array_contains("kinds", r.kind)), r, n) for n, r in enumerate(rules) if r.kind in indexed]
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionAll(more)
    names = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", "rank", "end", F.get(names, F.col("rank")).alias("kind"))
    spans = spans.distinct().groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans")).withColumnRenamed("key", "k")
    out = docs.select("doc_id", "key").join(spans, F.col("key").eqNullSafe(F.col("k")), "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.array_remove("spans.rank", n)) for n in range(len(BASE_RULES))]
    counts = [(F.size("spans") - c).cast("long").alias(f"n_{r.kind}") for c, r in zip(counts, BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same spans in SQL, every rule matched against every text."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, lengths[n] AS part,
         coalesce(list_sum(gaps[1:n]), 0) + coalesce(list_sum(wholes[1:n - 1]), 0) AS start,
         coalesce(list_sum(gaps[1:n]), 0) + list_sum(wholes[1:n]) AS stop, {rule.least} AS least
  FROM (SELECT *, unnest(range(1, len(wholes) + 1)) AS n FROM (
    SELECT doc_id, list_transform(string_split_regex(text, {pattern}), lambda x: length(x)) AS gaps,
           list_transform(regexp_extract_all(text, {pattern}), lambda x: length(x)) AS wholes,
           list_transform(regexp_extract_all(text, {pattern}, {rule.group}), lambda x: length(x)) AS lengths
    FROM texts WHERE regexp_matches(text, {pattern})))""")
    counts = ", ".join(f"count(*) FILTER (rank = {n}) AS n_{r.kind}" for n, r in enumerate(BASE_RULES))
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
grouped AS (
  SELECT doc_id, {counts}, {listed} FILTER (rank < {len(BASE_RULES)}) AS base, {listed} AS spans
  FROM found WHERE part >= least GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN grouped USING (doc_id)
"""


SQL = _sql()
