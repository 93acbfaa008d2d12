"""The n-gram join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from passagemill.llm import ngramjoin
from passagemill.session import child_names, shared_dir


def slow_set(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return frozenset(" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def slow_components(rows, percent=90):
    sets = [slow_set(text) for _, text in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    ids = defaultdict(list)
    for n, (id_, _) in enumerate(rows):
        if id_ is not None:
            ids[find(n)].append(id_)
    return [(id_, len(sets[n]), min(ids[find(n)], default=None)) for n, (id_, _) in enumerate(rows)]


KEY = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)


def compared(spark, rows, percent=90, part=4096):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, tokens string").repartition(6)
    got = ngramjoin.similar_documents(df, percent=percent, part=part)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(slow_components(rows, percent), key=KEY)


def test_join_is_brute_force(spark, corpus):
    compared(spark, [(r[0], r[1]) for r in corpus])


def edited(rng, words, share):
    return [w if rng.random() > share else f"z{rng.randrange(10 ** 6)}" for w in words]


@pytest.mark.parametrize("part", [4096, 5])
def test_crowds_of_near_copies_keep_every_link(spark, part):
    """Copies around a base that link with the base alone, a chain of edits, and texts that share a long passage."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    rows += [(n, " ".join(edited(rng, base, 0.02))) for n in range(60)]
    chain = [f"c{n}" for n in range(120)]
    for n in range(25):
        chain = [*chain]
        chain[rng.randrange(120)] = f"d{n}"
        rows.append((100 + n, " ".join(chain)))
    passage = [f"p{n}" for n in range(60)]
    for n in range(40):
        rows.append((200 + n, " ".join([f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 9))] + passage)))
    rows += [(300 + n, "Just Nine words that are here and no more " + "x " * (n % 3)) for n in range(6)]
    rows += [(400 + n, " ".join(f"t{k}" for k in range(n))) for n in range(8, 16)] + [(500, "A b"), (501, "a  B"), (502, "a"), (503, ""), (504, None)]
    rng.shuffle(rows)
    compared(spark, rows, part=part)


def test_other_thresholds(spark, corpus):
    compared(spark, [(r[0], r[1]) for r in corpus if r[0] != 110], percent=60)


def test_sets_do_not_stay_on_disk(spark, corpus):
    """Tables that hold whole sets go as soon as nothing reads them any more; the result does not need them."""
    folder = f"{shared_dir(spark)}/passagemill"
    before = set(child_names(spark, folder))
    compared(spark, [(r[0], r[1]) for r in corpus])
    kinds = {name.rsplit("-", 1)[0] for name in set(child_names(spark, folder)) - before}
    assert "sets" in kinds and not kinds & {"read", "prefixes", "active", "postings"}


def test_only_classes_of_pairs_are_moved(spark):
    active = spark.createDataFrame([(n, bytes([n])) for n in range(9)], "cls long, tokens binary").repartition(3)
    pairs = ngramjoin.keep(spark.createDataFrame([(1, 2), (1, 5), (3, 3)], "a long, b long"), "pairs")
    both = ngramjoin._with_both(pairs, active, "tokens")
    assert "LeftSemi" in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b, bytes(r.a_tokens), bytes(r.b_tokens)) for r in both.collect()) == \
        [(1, 2, b"\x01", b"\x02"), (1, 5, b"\x01", b"\x05"), (3, 3, b"\x03", b"\x03")]


def test_no_documents(nothing):
    assert ngramjoin.similar_documents(nothing).collect() == []


def test_prefixes_of_linked_sets_share_a_token():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(9, 80))
        a = np.sort(rng.choice(10 ** 6, n, replace=False).astype(np.uint64) * np.uint64(0x123456789ABCDEF))
        b = np.unique(np.r_[a[rng.random(n) > 0.05], rng.choice(10 ** 6, int(rng.integers(0, 3))).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common):
            continue
        assert len(np.unpackbits(np.frombuffer(ngramjoin._sketch(a), np.uint8) ^ np.frombuffer(ngramjoin._sketch(b), np.uint8)).nonzero()[0]) \
            <= len(a) + len(b) - 2 * common
        c, e = ngramjoin.prefix_length(len(a)) - 1 + ngramjoin.more_of(len(a)), ngramjoin._reach(len(b), 90)
        longer = [ngramjoin.first_of(x, k, ngramjoin.SECOND) for x, k in ((a, c), (b, e))]
        assert np.isin(*longer).sum() >= ngramjoin.more_of(len(a))
        for factor in (None, ngramjoin.SECOND):
            first = [ngramjoin.first_of(x, ngramjoin.prefix_length(len(x)), factor) for x in (a, b)]
            assert np.isin(*first).any()


@pytest.mark.parametrize("n", range(1, 40))
def test_sizes_that_can_link(n):
    best = max((100 * min(n, m) / max(n, m) for m in range(1, 60) if m != n), default=0)
    twin = 100 * (n - 1) / (n + 1)
    assert ngramjoin.can_link(n) == (max(best, twin) >= 90)
