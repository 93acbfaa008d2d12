"""SimHash, line windows and repeated passages against brute force."""

import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from passagemill.llm import linededup, simhash, substrings


def slow_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (id, fingerprint); smallest id reachable, by all pairs."""
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                group[find(a)] = find(b)
    least = defaultdict(list)
    for n, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(n)].append(id_)
    return [min(least[find(n)], default=None) for n in range(len(rows))]


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_simhash_is_brute_force(docs, corpus, shard_rows):
    got = simhash.near_duplicates(docs, shard_rows=shard_rows).collect()
    rows = [(r[0], slow_fingerprint(r[1])) for r in corpus]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_a_dense_cluster_keeps_every_link(spark, shard_rows):
    """Fingerprints in a chain, each two bits from the next, and a crowd around one of them."""
    chain = [0]
    for n in range(30):
        chain.append(chain[-1] ^ (1 << (2 * n)) ^ (1 << (2 * n + 1)))
    crowd = [(0xABCDEF0123456789 ^ (1 << a) ^ (1 << b)) for a in range(20) for b in range(a)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in chain + crowd})
    edges = simhash.link_shards(spark.createDataFrame([(v,) for v in values], "fp long"), shard_rows=shard_rows)
    roots = {r.u: r.v for r in simhash.components(edges).collect()}
    rows = [(n, v & (1 << 64) - 1) for n, v in enumerate(values)]
    want = slow_components(rows)
    assert [values.index(roots.get(v, v)) for v in values] == want


def test_rows_of_a_fingerprint_do_not_grow_with_the_input(spark):
    """Shards that are too large are dealt again, not paired."""
    rows = spark.range(16_000).select(F.xxhash64("id").alias("fp"))
    each = {}
    for n in (2000, 16_000):
        members = simhash.shard_members(rows.limit(n), shard_rows=n // 8192 + 4)
        got = members.agg(F.count("*").alias("rows"), F.max("trees").alias("trees")).first()
        each[n] = got.rows / n
        assert got.trees == 1
    assert 5 <= each[2000] <= 25 and each[16_000] <= 25


def test_masks_hold_every_bit_once():
    for level, masks in enumerate(simhash._masks(5, 3)):
        assert len(masks) == 5 ** (level + 1)
        for n in range(0, len(masks), 5):
            assert sum(m % (1 << 64) for m in masks[n:n + 5]).bit_count() == sum((m % (1 << 64)).bit_count() for m in masks[n:n + 5])
            path, used = n // 5, 0
            for above in reversed(range(level)):
                used |= simhash._masks(5, 3)[above][path]
                path //= 5
            assert (sum(m % (1 << 64) for m in masks[n:n + 5]) | used % (1 << 64)) == (1 << 64) - 1


def test_one_of_each_group_stays(docs, corpus):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    rows = [(r[0], slow_fingerprint(r[1])) for r in corpus]
    assert {i for i in ids if i is not None} == {c for c in slow_components(rows) if c is not None}


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.drop_near_duplicates(nothing).collect() == []
    assert linededup.dedup_lines(nothing).collect() == []
    assert substrings.dedup_passages(nothing).collect() == []


def test_line_windows_are_brute_force(docs, corpus):
    first = {}
    occurrences = sorted({(-1 if r[0] is None else r[0], r[1]) for r in corpus if r[1] is not None}, key=lambda x: x[0])
    for id_, text in occurrences:
        lines = text.split("\n")
        for n in range(len(lines) - 2):
            first.setdefault(tuple(lines[n:n + 3]), (id_, n))
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    want = []
    for r in corpus:
        if r[1] is None:
            want.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        gone = set()
        for n in range(len(lines) - 2):
            if first[tuple(lines[n:n + 3])] != (-1 if r[0] is None else r[0], n):
                gone |= {n, n + 1, n + 2}
        want.append((r[0], "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines), len(gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=key) == sorted(want, key=key)


def test_rows_of_one_id_and_other_texts_are_told_apart(spark):
    shared = "a b\nc d\ne f"
    rows = [(1, shared), (2, shared + "\nx"), (2, "y\n" + shared), (2, "z")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == ["a b\nc d\ne f", "x", "y", "z"]


@pytest.mark.parametrize("leaves", [2_000_000, 40])
def test_passages_are_brute_force(docs, corpus, leaves):
    first = {}
    for id_, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in corpus}):
        words = text.encode().split()
        for n in range(len(words) - 12):
            first.setdefault(tuple(words[n:n + 13]), id_)
    want = []
    for r in corpus:
        words = (r[1] or "").encode().split()
        covered = [False] * len(words)
        for n in range(len(words) - 12):
            if first[tuple(words[n:n + 13])] < (-1 if r[0] is None else r[0]):
                covered[n:n + 13] = [True] * 13
        want.append((r[0], b" ".join(w for w, c in zip(words, covered) if not c).decode(), len(words), sum(covered)))
    got = substrings.dedup_passages(docs, leaves=leaves).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r.removed) == r.n_removed
        assert all(a["end"] < b["start"] for a, b in zip(r.removed, r.removed[1:]))


def test_many_rows_under_one_id_and_the_least_id(spark, monkeypatch):
    """Texts without an id, or under one, are cut in parts; the least number of 64 bits is an id like any other."""
    monkeypatch.setattr(substrings, "PART_BYTES", 2000)
    passage = " ".join(f"p{n}" for n in range(20))
    least = -(1 << 63)
    rows = [(None, f"n{n} {passage} m{n}") for n in range(300)] + [(least, f"l {passage}"), (7, passage), (7, f"x {passage} y")]
    got = sorted(((r.doc_id, r.kept) for r in substrings.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == [(least, "l"), (7, ""), (7, "x y")] + sorted((i, t) for i, t in rows if i is None)
    one = [(least, passage), (3, passage)]
    assert {(r.doc_id, r.n_removed) for r in substrings.dedup_passages(spark.createDataFrame(one, "doc_id long, text string")).collect()} == {(least, 0), (3, 20)}
    with pytest.raises(ValueError):
        substrings.dedup_passages(spark.createDataFrame([(least, "a"), (-1 - least, "b")], "doc_id long, text string"))
