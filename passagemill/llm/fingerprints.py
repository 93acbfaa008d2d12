"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. For each of the
fingerprint's places k, each word draws r and c from Gamma(2, 1) and b from
[0, 1), all from hashes of the word and k; with t = floor(ln w / r + b) and
ln y = r (t - b), the word with the least ln a = ln c - ln y - r is the sample.
Two documents have the same sample at a place with the probability of their
generalised Jaccard similarity, sum of least over sum of greatest weights.

As r, b and c depend on word and place alone, equal samples have equal values
``a`` and others practically never, so the place keeps a hash of its least
``a``. All of it is DataFrame operations: texts are shuffled by document once,
words are counted and sampled where they are (the places in groups, so that
generated code stays small enough to be compiled), and only samples leave.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import table
from passagemill.session import keep

#: Places of a fingerprint: groups x places of a group.
GROUPS, GROUP_PLACES = 4, 8


def _followers(rows: DataFrame) -> DataFrame:
    """k, its next larger k (after the largest the smallest), the smallest text hash
    of that one, and the most characters that k needs of it. ``rows``: k, th, n."""
    ids = rows.groupBy("k").agg(F.min("th").alias("first_th"), F.max(F.floor(F.col("n") / 2)).cast("int").alias("half"))
    ids = keep(ids.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ids")
    first = ids.groupBy("part").agg(F.min_by(F.struct("k", "first_th"), "k").alias("head"))
    # One row for each partition of the ids.
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = first.select("part", F.coalesce(F.lead("head").over(in_order), F.first("head").over(in_order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_head"))
    inside = F.lead(F.struct("k", "first_th")).over(Window.partitionBy("part").orderBy("k"))
    linked = ids.withColumn("inside", inside).join(F.broadcast(heads), "part")
    then = F.coalesce("inside", "next_head")
    return linked.select("k", "half", then["k"].alias("next_k"), then["first_th"].alias("next_th"))


def _uniform(bits: Column, width: int) -> Column:
    """A number above 0 and below 1 from so many bits."""
    return (bits.cast("double") + 0.5) * F.lit(2.0 ** -width)


def _draws(term: Column, place: Column) -> tuple[Column, Column, Column]:
    """r, b and ln c of a term at a place; -ln(u v) of two uniform numbers is of Gamma(2, 1)."""
    one, two = F.xxhash64(term, place), F.xxhash64(term, place, F.lit("c"))
    r = -F.log(_uniform(F.shiftrightunsigned(one, 42), 22) * _uniform(F.shiftrightunsigned(one, 20).bitwiseAND(F.lit((1 << 22) - 1)), 22))
    b = one.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * F.lit(2.0 ** -20)
    c = F.log(-F.log(_uniform(F.shiftrightunsigned(two, 32), 32) * _uniform(two.bitwiseAND(F.lit(0xFFFFFFFF)), 32)))
    return r, b, c


def _samples(sides: DataFrame) -> DataFrame:
    """k, th, info, samples of the text and of the edited text.

    ``sides`` has k, th, side, text: side 0 is the text, 1 the edited text, and
    2 no text but what ``info`` shall be.
    """
    words = F.when(F.col("side") == 2, F.array(F.col("text"))).otherwise(F.split(F.lower("text"), r"[\x20\x09-\x0D]+", -1))
    terms = sides.select("k", "th", "side", F.explode(words).alias("word")).where("word <> '' OR side = 2")
    terms = terms.select(
        "k", "th", "side", F.when(F.col("side") < 2, F.xxhash64("word")).otherwise(0).alias("term"),
        F.when(F.col("side") == 2, F.col("word")).alias("info"))
    counted = terms.groupBy("k", "th", "term", "info").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("own"), F.count(F.when(F.col("side") == 1, 1)).alias("edited"))
    groups = F.when(F.col("info").isNull(), F.sequence(F.lit(0), F.lit(GROUPS - 1))).otherwise(F.array(F.lit(-1)))
    rows = counted.select(
        "k", "th", "info", "term", F.when(F.col("own") > 0, F.log(F.col("own").cast("double"))).alias("own"),
        F.when(F.col("edited") > 0, F.log(F.col("edited").cast("double"))).alias("edited"), F.explode(groups).alias("g"))
    draws = []
    for n in range(GROUP_PLACES):
        for name, draw in zip(("r", "b", "c"), _draws(F.col("term"), F.col("g") * GROUP_PLACES + n)):
            draws.append(draw.alias(f"{name}{n}"))
    rows = rows.select("k", "th", "info", "g", "own", "edited", *draws)

    def least(weight: str, n: int) -> Column:
        r, b, c = (F.col(f"{x}{n}") for x in "rbc")
        t = F.floor(F.col(weight) / r + b).cast("double")
        return F.min(c - r * (t - b + 1))

    rows = rows.groupBy("k", "th", "info", "g").agg(
        *[least("own", n).alias(f"own{n}") for n in range(GROUP_PLACES)], *[least("edited", n).alias(f"edited{n}") for n in range(GROUP_PLACES)])

    return rows.select("k", "th", "info", "g", F.array(*[_short(f"own{n}") for n in range(GROUP_PLACES)]).alias("own"),
                       F.array(*[_short(f"edited{n}") for n in range(GROUP_PLACES)]).alias("edited"))


def _short(name: str) -> Column:
    """The 32 bits that a place keeps; 0 for a text without words."""
    return F.when(F.col(name).isNull(), 0).otherwise(F.shiftright(F.xxhash64(name), 32)).cast("int")


def _hex(places: Column) -> Column:
    low = F.lit(0xFFFFFFFF)
    return F.array_join(F.transform(places, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(low)), 8, "0"))), "")


def _likeness(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(GROUPS * GROUP_PLACES))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next. The edited text ends with the beginning of the next
    document, by ascending doc_id, in place of its last half. A null text is
    empty, and the fingerprint of a text without words is all zeros (equal to
    any other such). A null doc_id sorts first. Of rows that share a doc_id, the
    one with the smallest text hash is what precedes others; rows that repeat
    text too have equal results. Other columns are not read.
    """
    # A null id is a key like any other, and sorts first.
    id_ = F.col("doc_id").cast("long")
    # Of the type that it is read back with, or a join casts it and what it has dealt by it is dealt again.
    key = F.struct(id_.isNotNull().alias("named"), F.coalesce(id_, F.lit(0)).alias("id")).cast("struct<named:boolean,id:bigint>")
    rows = docs.select(key.alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    keys = keep(rows.select("k", "th", F.length("text").alias("n")), "keys")
    repeated = not keys.groupBy("k", "th").count().where("count > 1").isEmpty()
    once = rows.dropDuplicates(["k", "th"]) if repeated else rows
    after = keep(_followers(keys), "followers")
    begins = after.select(F.col("k").alias("owner"), "half", "next_k", "next_th")
    # Both joins are dealt by k alone, so that one shuffle of the texts serves both.
    this = F.least("th", "next_th") == F.greatest("th", "next_th")
    begins = once.join(begins, (F.col("k") == F.col("next_k")) & this) \
        .select(F.col("owner").alias("k"), F.substring("text", F.lit(1), F.col("half")).alias("begin"))
    both = once.join(begins, "k")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("begin", F.lit(1), half))
    both = both.select("k", "th", "text", edited.alias("edited"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")),
        F.struct(F.lit(2).alias("side"), F.concat_ws(":", n, F.sha2("edited", 256)).alias("text")))
    sampled = _samples(both.select("k", "th", F.explode(sides).alias("s")).select("k", "th", "s.side", "s.text"))
    empty = F.array_repeat(F.lit(0), GROUPS * GROUP_PLACES)

    def in_order(side: str) -> Column:
        ordered = F.flatten(F.transform(F.array_sort("groups"), lambda x: x[side]))
        return F.when(F.size("groups") == 0, empty).otherwise(ordered)

    marks = sampled.groupBy("k", "th").agg(
        F.max("info").alias("info"), F.collect_list(F.when(F.col("g") >= 0, F.struct("g", "own", "edited"))).alias("groups"))
    marks = keep(marks.select("k", "th", F.split("info", ":").alias("info"), in_order("own").alias("own"), in_order("edited").alias("edited")), "marks")
    follow = marks.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), F.col("own").alias("next_own"))
    out = marks.join(after.select("k", "next_k", "next_th"), "k").join(follow, ["next_k", "next_th"])
    if repeated:
        out = keys.select("k", "th").join(out, ["k", "th"])
    return out.select(
        F.when(F.col("k.named"), F.col("k.id")).alias("doc_id"), F.get("info", F.lit(0)).cast("long").alias("n_chars"),
        F.get("info", F.lit(1)).alias("edited_sha256"), _hex(F.col("own")).alias("fingerprint"), _hex(F.col("edited")).alias("edited_fingerprint"),
        _likeness(F.col("own"), F.col("edited")).alias("near_edited"), _likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
