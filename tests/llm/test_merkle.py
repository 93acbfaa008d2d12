"""The Merkle manifest against a plain tree, level by level."""

import hashlib
import zlib

import pytest

from passagemill.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def steps_of(levels, at):
    """Nodes beside the one at ``at``, level by level, each with whether it stands left."""
    out = []
    for nodes in levels[:-1]:
        pair = at ^ 1
        out.append((nodes[pair], pair < at) if pair < len(nodes) else None)
        at //= 2
    return out


def slow_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r[0], r[3], r[2], r[4], r[1]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = levels_of([x[1] for x in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (doc_id, own, r) in enumerate(groups[name]):
            steps = steps_of(trees[name], at) + steps_of(top, k)
            hit = doc_id is not None and r[4] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = leaf(doc_id, r[3], r[2], r[4] + 1, r[1]) if hit else own
            for s in steps:
                node = h(node) if s is None else h(s[0], node) if s[1] else h(node, s[0])
            root = top[-1][0]
            out.append((doc_id, own, trees[name][-1][0], root, h(*(s[0] for s in steps if s)), node, node == root))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, r[1:])


def of_query(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return merkle.op12_merkle_manifest(spark, str(tmp_path))


def test_manifest_is_a_plain_tree(spark, tmp_path, docs, corpus):
    rows = [tuple(r[:5]) for r in corpus] + [(500 + n, f"t{n}", lang, None, n) for n, lang in enumerate(["", "é", "zz", "zz", "zz", "EN", None])]
    # A third of all rows are one row.
    rows += [(77, "copy", "en", "s", 4)] * 60 + [(78, "big", "fr", "s", (1 << 63) - 1)]
    extra = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at int, digest string")
    got = of_query(spark, tmp_path, extra.repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=KEY)
    assert got == sorted(slow_manifest(rows), key=KEY)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("bits, count", [(1, 1), (1, 3), (1, 8), (1, 13), (2, 5), (2, 64), (10, 13)])
def test_blocks_change_nothing(spark, bits, count):
    """Any number of leaves and size of block gives the tree of the plain rule, and each witness leads to the root."""
    rows = [(n, f"t{n}", "ab"[n % 5 == 0], "s", n) for n in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(df, bits=bits).collect()
    want = {r[0]: r for r in slow_manifest(rows)}
    for r in got:
        _, own, subroot, root, proof, _, _ = want[r.doc_id]
        assert (r.leaf.hex(), r.subroot.hex(), r.root.hex()) == (own, subroot, root)
        assert h(r.proof.hex()) == proof
        node, at, proof = own, 0, r.proof.hex()
        for side in r.sides:
            other = proof[at:at + 64] if side != "-" else ""
            node, at = h(other, node) if side == "L" else h(node, other), at + len(other)
        assert node == root and at == len(proof)
    assert len(got) == count


def test_no_documents(spark, tmp_path, nothing):
    assert of_query(spark, tmp_path, nothing).collect() == []


def test_appending_extends_open_witnesses():
    tree = merkle.Appender()
    digests = [hashlib.sha256(bytes([n])).digest() for n in range(6)]
    for n, digest in enumerate(digests):
        tree.append(digest)
        assert [height for height, _, _ in tree.open] == [k for k in range(3, -1, -1) if (n + 1) >> k & 1]
    assert tree.sides == ["RR", "LR", "RL", "LL", "R", "L"]
    assert bytes(tree.proofs[5]) == digests[4]
    root = tree.finish()
    assert tree.sides == ["RRR", "LRR", "RLR", "LLR", "R-L", "L-L"]
    assert root.hex() == levels_of([d.hex() for d in digests])[-1][0]
