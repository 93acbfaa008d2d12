"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagemill.llm import decontaminate, linededup, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"
BAD = ["gronk", "gronky", "blarg", "zzap"]


def sentence(rng, n):
    return " ".join(rng.choice("amber birch cedar delta ember fern grove heath iris juniper".split()) + rng.choice(["", "s", "en", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    """Junk repeats words; toxic texts have a few words of one kind, wherever."""
    rng = random.Random(9)
    docs, labels = [], []
    for n in range(420):
        junk, toxic = n % 4 == 0, n % 3 == 0
        words = sentence(rng, rng.randint(30, 160)).split()
        if junk:
            words = [w for w in words for _ in range(6)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((n, " ".join(words), "x", 1.0))
        if n % 10:
            labels.append((n, int(not junk), int(toxic), "y"))
    odd = [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (None, "amber", "x", 1.0), docs[1], docs[1], (9002, " !! \n", "x", 1.0), (9003, "fern " * 60_000, "x", 1.0)]
    labels += [(1, 1, 1, "y"), (None, 0, 1, "y"), (77777, 0, 1, "y"), (5, None, None, "y"), (9003, 0, 0, "y")]
    return (spark.createDataFrame(docs + odd, "doc_id long, text string, score string, quality double").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), len(docs) + len(odd))


@pytest.mark.parametrize("classify, label, modulus, rest", [
    (quality.classify, lambda n: n % 4 != 0, 4, 2), (toxicity.score_toxicity, lambda n: n % 3 == 0, 5, 0)])
def test_held_out_rows_are_told_apart(texts, classify, label, modulus, rest):
    docs, labels, many = texts
    rows = classify(docs, labels).collect()
    assert len(rows) == many
    assert all(0 <= r.score <= 1 and np.isfinite(r.score) and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    held = [(r.score, label(r.doc_id)) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    positive, negative = (np.array([s for s, y in held if y == want]) for want in (True, False))
    assert (positive[:, None] > negative).mean() > 0.9
    assert len({r.score for r in rows if r.doc_id in (9000, 9001, 9002)}) <= 2
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


@pytest.mark.parametrize("classify", [quality.classify, toxicity.score_toxicity])
def test_scores_without_labels_or_rows(texts, classify):
    docs, labels, many = texts
    few = docs.where("doc_id < 20")
    assert {r.score for r in classify(few, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).collect() == []


def test_gradients_are_those_of_the_loss(monkeypatch):
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, toxicity.WORD_SIZE + toxicity.GRAM_SIZE))
    x[0] = 0
    index = rng.integers(1, 9, (5, 6))
    index[0, 4:] = 0
    y = np.array([0, 1, 1, 0, 1.0])
    grads, _ = net.gradients(net.gates(x), index, y)

    def loss():
        logits = net.read(net.gates(x), index)
        return np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits)))

    for name in ("o", "v", "A", "a", "Uf", "Cf", "Ub", "Cb"):
        values = net.p[name].reshape(-1)
        kept = values[1]
        values[1] = kept + 1e-2
        above = loss()
        values[1] = kept - 1e-2
        below = loss()
        values[1] = kept
        assert abs((above - below) / 2e-2 - grads[name].reshape(-1)[1]) < 1e-5


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        seen = toxicity.windows_of(np.arange(1, n + 1))
        assert set(seen.ravel().tolist()) - {0} == set(range(1, n + 1)) and seen.shape[1] == toxicity.WINDOW


def test_pipeline_stages(spark):
    """Each stage beside the plain outcome of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kinds = [name for name, _ in corpus_pipeline.STAGES]
    assert kinds == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10 ** 6, "", "en", "s", 0)], docs.schema)).cache()
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.is_held_out()).where("quality = 1")
    kept = good.join(labels, "doc_id").count() / docs.join(labels, "doc_id").count()
    assert good.columns == columns and kept > 0.97 and good.count() < docs.count()
    lines = corpus_pipeline.line_dedup(spark, good, SF).cache()
    want = {(r.doc_id, r.text) for r in linededup.dedup_lines(good).where("n_removed = 0 OR text <> ''").collect()}
    assert lines.columns == columns and {(r.doc_id, r.text) for r in lines.collect()} == want
    assert lines.where("n_chars <> length(text)").count() == 0
    single = corpus_pipeline.near_dedup(spark, lines, SF).cache()
    stay = {r.component_id for r in simhash.near_duplicates(lines).collect()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == stay
    clean = corpus_pipeline.decontamination(spark, single, SF).cache()
    leaks = {r.doc_id for r in decontaminate.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and clean.columns == columns and {r.doc_id for r in clean.collect()} == stay - leaks
    placed = corpus_pipeline.packing(spark, clean, SF)
    assert {r.doc_id for r in placed.collect()} == stay - leaks
    assert placed.agg(F.sum("length")).first() == packing.cut_pieces(clean).agg(F.sum("length")).first()


def test_filters_tell_rows_without_or_with_one_id_apart(spark, texts):
    """Several null ids and several texts of one id: each row goes by its own text."""
    rng = random.Random(4)
    near, leak, junk, *good = (sentence(rng, 60) for _ in range(6))
    schema = "doc_id long, text string"
    rows = [(i, t) for i in (None, 5) for t in (leak, junk, *good[:2])] + [(None, near), (None, near), (3, near), (None, good[2]), (None, good[2].upper())]
    docs = spark.createDataFrame(rows, schema)

    def left(kept):
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in kept.collect())

    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert left(decontaminate.drop_leaks(docs, items)) == sorted((-1 if i is None else i, t) for i, t in rows if t != leak)
    single = left(simhash.drop_near_duplicates(docs))
    lowered = [t.lower() for _, t in single]
    assert sorted(lowered) == sorted({t.lower() for _, t in rows}) and (3, near) in single
    assert {(5, t) for t in (leak, junk, *good[:2])} <= set(single)
    labelled, labels, _ = texts
    some = {r.doc_id: r.text for r in labelled.where("doc_id BETWEEN 100 AND 123").collect()}
    copies = labelled.where("doc_id BETWEEN 100 AND 123").withColumn("doc_id", F.lit(None).cast("long"))
    kept = quality.keep_good(labelled.where("doc_id < 9000").unionByName(copies), labels).select("doc_id", "text").collect()
    stay = {r.doc_id for r in kept} & set(some)
    assert 0 < len(stay) < len(some) and sorted(r.text for r in kept if r.doc_id is None) == sorted(some[i] for i in stay)


@pytest.mark.parametrize("many", [39, 40, 41, 70, 71, 100, 1000])
def test_long_words_are_read_whole(many):
    word = "".join(chr(0x4E00 + n) for n in range(many))
    lexicon = toxicity.Lexicon()
    index, inputs = lexicon.of("x " + word + " x"), lexicon.take_new()
    assert len(index) == len(inputs.word) + 1 and all(len(p) <= toxicity.PIECE for p in lexicon.at)
    read = set(inputs.flat.tolist())
    assert {toxicity.xxhash.xxh64_intdigest(word[n:n + 3]) % toxicity.GRAM_SLOTS for n in range(many - 2)} <= read
    assert {toxicity.xxhash.xxh64_intdigest(x) % toxicity.GRAM_SLOTS for x in ("^" + word[:2], word[-2:] + "$")} <= read


def test_a_callers_columns_stay(spark):
    """Columns named like the operators' own are kept, with their values."""
    rows = [(n, f"some words number {n} that are here", f"r{n}", n, -n) for n in range(4)] + [(3, "some words number 3 that are here", "r3", 3, -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __other_0 int, __other_1 int")
    items = spark.createDataFrame([(1, "some words number 2 that are here")], "item_id long, text string")
    for kept, ids in ((simhash.drop_near_duplicates(docs, max_bits=0), {0, 1, 2, 3}), (decontaminate.drop_leaks(docs, items), {0, 1, 3})):
        assert kept.columns == docs.columns
        assert {(r.doc_id, r["__row"], r["__other_0"], r["__other_1"]) for r in kept.collect()} == {(n, f"r{n}", n, -n) for n in ids}


def test_an_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
