import hashlib
import io

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions.paths import classify_kind, file_ext, file_name, is_visible
from passagemill.functions.text import content_preview, decode_bytes, decode_text, is_nonblank, render_prompt, row_to_text, trim_blanks
from passagemill.operators.cards import csv_cards, table_card
from passagemill.plans.ingest import load_documents
from passagemill.settings import Settings
from passagemill.sources.csvfiles import scan_csv
from passagemill.sources import rawfiles
from passagemill.sources.rawfiles import hash_files, list_files, scan_files

TREE = {
    "a.md": b"hello\r\nworld",
    "sub/README": b"s\n",
    "README.TXT": b"any",
    "x.py": b"print(1)",
    "__init__.py": b"",
    "_priv/p.md": b"p",
    ".git/config": b"g",
    ".env": b"h",
    ".hidden.md": b"h",
    "blank.txt": b"  \n",
    "odd.txt": b"caf\xe9x",
    "even.txt": b"caf\xe9",
    "bom.txt": b"\xff\xfeh\x00i\x00",
    "bom8.txt": b"\xef\xbb\xbfhi",
    "badsur.txt": b"\x00\xd8\x41\x00",
    "big.log": b"x" * 1024 * 1024,
    "small.log": b"y" * 10,
    "big.md": b"z" * (1024 * 1024 + 1),
    "t.csv": b"a,b\n1,\n",
    "t.tsv": b"a\tb\n1\t2\n",
    "wide.csv": b"n,s\n" + b"".join(b"%d,v%d\n" % (i, i) for i in range(13)),
    "broken.csv": b"",
    "img.png": b"\x89picture",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(tmp_path)


def relative(rows, root):
    return {row["path"][len(root) + 1:]: row for row in rows}


def test_scan_finds_every_file(spark, tree):
    found = relative(scan_files(spark, tree).collect(), tree)
    assert set(found) == set(TREE)
    for name, content in TREE.items():
        assert bytes(found[name]["content"]) == content
        assert found[name]["length"] == len(content)
        assert found[name]["hash"] == hashlib.md5(content).hexdigest()


def test_hashes_match_without_reading_into_rows(spark, tree):
    hashed = relative(hash_files(list_files(spark, tree)).collect(), tree)
    assert {n: r["hash"] for n, r in hashed.items()} == {n: hashlib.md5(c).hexdigest() for n, c in TREE.items()}


def test_fast_mode_leaves_out_hidden_names(spark, tree):
    found = {row["path"].rsplit("/", 1)[-1] for row in scan_files(spark, tree, "fast").collect()}
    assert "a.md" in found and "__init__.py" not in found
    with pytest.raises(ValueError):
        scan_files(spark, tree, "other")


def test_missing_root_is_empty(spark, tmp_path):
    assert list_files(spark, str(tmp_path / "none")).collect() == []


def test_linked_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.md").write_text("x")
    (tmp_path / "in" / "loop").symlink_to(tmp_path / "in")
    assert list_files(spark, str(tmp_path / "in")).count() == 1


def test_load_documents(spark, tree):
    documents = load_documents(spark, tree, image_text=lambda raw: " seen \n", moment=F.to_timestamp(F.lit("2026-01-01")))
    found = relative(documents.collect(), tree)
    content = {name: row["content"] for name, row in found.items()}
    assert set(content) == set(TREE) - {".env", "blank.txt", "big.log", "broken.csv"}
    assert content["a.md"] == "hello\nworld"
    assert content["x.py"] == "Source code file (.py):\nprint(1)"
    assert content["__init__.py"] == "Source code file (.py):\n"
    assert content["odd.txt"] == "caféx"
    assert content["even.txt"] == "café"
    assert content["bom.txt"] == "hi"
    assert content["bom8.txt"] == "﻿hi"
    assert content["badsur.txt"] == "\x00ØA\x00"
    assert content["img.png"] == "OCR extracted text from image:\nseen"
    assert content["t.csv"] == "CSV File: t.csv\nColumns: a, b\nNumber of rows: 1\n\nData preview:\nRow 1: a: 1 | b: nan"
    assert content["t.tsv"].endswith("Row 1: a: 1 | b: 2")
    assert "Number of rows: 13" in content["wide.csv"] and content["wide.csv"].count("\nRow ") == 10
    assert found["README.TXT"]["file_type"] == ".txt" and found["sub/README"]["file_type"] == ""
    assert found["big.md"]["file_size"] == 1024 * 1024 + 1


def test_images_without_a_function_or_with_a_failing_one(spark, tree):
    def fail(raw):
        raise RuntimeError("no")

    for fn in (None, fail):
        documents = load_documents(spark, tree, image_text=fn)
        assert not [r for r in documents.select("path").collect() if r["path"].endswith(".png")]


def test_size_cap_is_a_setting(spark, tree):
    names = relative(load_documents(spark, tree, settings=Settings(max_file_bytes=5)).collect(), tree)
    assert "small.log" not in names and "big.md" in names


def test_names_and_kinds(spark):
    names = ["a.md", "A.MD", "README", "Readme.md", ".env", "a.", "..b", "x.Py", "t.tsv", "i.JPG", "z.zip", ".hidden.md", ".MD", ".x.TXT"]
    rows = spark.createDataFrame([(f"/r/{n}",) for n in names], "path string")
    rows = rows.withColumn("n", file_name(F.col("path"))).withColumn("e", file_ext(F.col("n")))
    got = {r["n"]: (r["e"], r["k"], r["v"]) for r in rows.select("n", "e", classify_kind(F.col("n"), F.col("e")).alias("k"), is_visible(F.col("n")).alias("v")).collect()}
    assert got == {
        "a.md": (".md", "text", True), "A.MD": (".md", "text", True), "README": ("", "text", True),
        "Readme.md": (".md", "text", True), ".env": ("", "other", False), "a.": ("", "other", True),
        "..b": (".b", "other", False), "x.Py": (".py", "code", True), "t.tsv": (".tsv", "csv", True),
        "i.JPG": (".jpg", "image", True), "z.zip": (".zip", "other", True), ".hidden.md": (".md", "text", True),
        ".MD": ("", "other", False), ".x.TXT": (".txt", "text", False),
    }


def test_decode_column(spark):
    cases = [TREE[n] for n in ("a.md", "odd.txt", "even.txt", "bom.txt", "bom8.txt", "badsur.txt")] + [None, b"", b"a\rb"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary")
    got = [r[1] for r in rows.select("i", decode_text(F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == ["hello\nworld", "caféx", "café", "hi", "﻿hi", "\x00ØA\x00", "", "", "a\nb"]


def test_blank_and_trim_follow_python(spark):
    texts = ["", " \t\r\n", "\x1c\x1d\x1e\x1f", "\x85\xa0     　", "​", " a b \n", "　x\x85", "x\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", is_nonblank(F.col("t")), trim_blanks(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [bool(t.strip()) for t in texts]
    assert [r[2] for r in got] == [t.strip() for t in texts]


def test_preview_boundary(spark):
    row = spark.range(1).select(content_preview(F.lit("a" * 200)).alias("x"), content_preview(F.lit("é" * 201)).alias("y")).first()
    assert row["x"] == "a" * 200 and row["y"] == "é" * 200 + "..."


def test_prompt_keeps_other_braces(spark):
    row = spark.range(1).select(render_prompt(F.lit("{x} {question}"), F.lit("q?"), "A {context} B {question} {C}")).first()
    assert row[0] == "A {x} {question} B q? {C}"


def test_row_text_and_card(spark):
    rows = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert {r[0] for r in rows.select(row_to_text(["a", "b"])).collect()} == {"a: 2 | b: nan", "a: 1 | b: x"}
    card = table_card(rows, "t", "a", 1).first()["content"]
    assert card == "CSV File: t\nColumns: a, b\nNumber of rows: 2\n\nData preview:\nRow 1: a: 1 | b: x"
    empty = table_card(rows.limit(0), "t", "a").first()["content"]
    assert empty == "CSV File: t\nColumns: a, b\nNumber of rows: 0\n\nData preview:"


TABLES = {
    "ints.csv": "id,zip,ratio,flag,note\n1,007,1,True,x\n2,,2.5,false,\"a,\nb\"\n",
    "plain.csv": "k,v\n" + "".join(f"{i},{'NA' if i % 3 else i}\n" for i in range(500)),
    "quoted.csv": 'k,v\n' + "".join(f'{i},"line\n{i}"\n' for i in range(300)),
    "header.csv": "a,b\n",
    "_odd.csv": "a\n" + "1\n" * 400,
}


def test_large_tables_split_and_agree_with_small_ones(spark, tmp_path):
    for name, text in TABLES.items():
        (tmp_path / name).write_text(text)
    files = list_files(spark, str(tmp_path))
    whole = {r["path"]: r["content"] for r in csv_cards(files).collect()}
    split = {r["path"]: r["content"] for r in csv_cards(files, split_bytes=1).collect()}
    assert whole == split and len(whole) == len(TABLES)
    ints = whole[f"{tmp_path}/ints.csv"]
    assert "Row 1: id: 1 | zip: 7 | ratio: 1.0 | flag: True | note: x" in ints
    assert "Row 2: id: 2 | zip: nan | ratio: 2.5 | flag: False | note: a,\nb" in ints
    assert "Number of rows: 500" in whole[f"{tmp_path}/plain.csv"]
    assert "Number of rows: 300" in whole[f"{tmp_path}/quoted.csv"]
    assert whole[f"{tmp_path}/header.csv"].endswith("Number of rows: 0\n\nData preview:")


def test_scan_csv_infers_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,u\n")
    (tmp_path / "b.csv").write_text("x,y\n2,w\n")
    rows = scan_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert dict(rows.dtypes)["x"] == "int"
    assert {(r["x"], r["y"], r["source_path"].rsplit("/", 1)[-1]) for r in rows.collect()} == {(1, "u", "a.csv"), (2, "w", "b.csv")}


@given(st.binary(max_size=12) | st.text(max_size=8).map(lambda t: t.encode("utf-16")) | st.text(max_size=8).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_decoding_follows_text_files(raw):
    def read():
        for encoding in ("utf-8", "utf-16", "latin-1", "cp1252"):
            try:
                return io.TextIOWrapper(io.BytesIO(raw), encoding=encoding).read()
            except UnicodeDecodeError:
                continue
        return ""

    assert decode_bytes(raw).replace("\r\n", "\n").replace("\r", "\n") == read()


def test_a_reader_holds_few_files_at_once(tmp_path):
    size, paths = 1024 * 1024, []
    for n in range(20):
        paths.append(str(tmp_path / f"{n}.txt"))
        (tmp_path / f"{n}.txt").write_bytes(b"%d" % (n % 10) * size)
    wanted = pd.DataFrame({"path": paths, "length": [size] * 20, "kind": ["text"] * 20})
    batches = list(rawfiles._read_texts(None, ("utf-8",))(iter([wanted])))
    assert max(batch["text"].str.len().sum() for batch in batches) <= 9 * size
    read = pd.concat(batches)
    assert list(read["path"]) == paths and [text[0] for text in read["text"]] == [str(n % 10) for n in range(20)]
