import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.operators.chunking import chunk_fixed, chunk_recursive, split_text

texts = st.text(alphabet="ab \n\té😀", max_size=400)


def windows(text, size, overlap):
    out, start = [], 0
    while text:
        out.append(text[start:start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@given(texts, st.integers(2, 40), st.data())
@settings(max_examples=400, deadline=None)
def test_recursive_properties(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    chunks = split_text(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size for c in chunks)
    if len(text) <= size:
        assert chunks == ([text.strip()] if text.strip() else [])
    # Every visible character is in some chunk, in order.
    remaining = iter("".join(chunks))
    assert all(c in remaining for c in text if not c.isspace())


@given(st.text(alphabet="abé😀", max_size=300), st.integers(2, 40), st.data())
@settings(max_examples=200, deadline=None)
def test_without_separators_recursive_is_fixed(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    assert split_text(text, size, overlap) == windows(text, size, overlap)


def test_paragraphs_first():
    long = "w" * 30 + " " + "x" * 30
    text = f"one\n\ntwo\n\n{long}\n\nthree"
    assert split_text(text, 40, 10) == ["one\n\ntwo", "w" * 30, "x" * 30, "three"]


def test_overlap_carries_whole_pieces():
    assert split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_only_paragraph_breaks():
    assert split_text("\n\n\n\n\n\n", 3, 1) == []


def test_custom_separators_keep_long_pieces():
    assert split_text("aaaa|bb", 3, 0, ("|",)) == ["aaaa", "|bb"]


CASES = ["", "short", "x" * 1000, "y" * 1001, "é😀 " * 900, "a\n\n" + "b" * 2500 + "\n\nc", " \n ", None, "q" * 1801]


def test_spark_chunks_equal_the_helper(spark):
    rows = spark.createDataFrame([(str(i), t, ".md") for i, t in enumerate(CASES)], "path string, content string, file_type string")
    got = {}
    for r in chunk_recursive(rows).collect():
        got.setdefault(r["path"], {})[r["chunk_no"]] = r["content"]
        assert r["chunk_id"] == hashlib.md5(f"{r['path']}#{r['chunk_no']}".encode()).hexdigest()
        assert r["file_type"] == ".md"
    want = {str(i): dict(enumerate(split_text(t, 1000, 200))) for i, t in enumerate(CASES) if t and t.strip()}
    assert got == want


@pytest.mark.parametrize("size,overlap", [(1000, 200), (7, 0), (10, 9), (5, 3), (1, 0)])
def test_fixed_windows(spark, size, overlap):
    cases = [t[:60] if t and size < 100 else t for t in CASES]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "path string, content string")
    got = {}
    for r in chunk_fixed(rows, size, overlap).collect():
        got.setdefault(r["path"], {})[r["chunk_no"]] = r["content"]
    assert got == {str(i): dict(enumerate(windows(t, size, overlap))) for i, t in enumerate(cases) if t}


def test_bad_sizes(spark):
    rows = spark.createDataFrame([("a", "b")], "path string, content string")
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunk_fixed(rows, size, overlap)
        with pytest.raises(ValueError):
            chunk_recursive(rows, size, overlap)
