"""Overlapping writers, late documents, stale text and compaction."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagemill import ingest, load_store
from passagemill.schemas import DOCUMENTS
from passagemill.sources import store as S
from passagemill.sources.manifest import read_manifest, write_manifest
from passagemill.sources.versions import VersionConflict, newest_number, write_version
from passagemill.streaming.ingest import NewestVersion, ingest_stream


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").withColumns({
        "chunk_id": F.col("path"), "chunk_no": F.lit(0).cast("long"), "embedding": F.array(F.lit(1.0))})


def texts(spark, path):
    return sorted((r.path, r.content) for r in S.load_store(spark, path).collect())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_overlapping_appends_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    S.create_store(chunks_of(spark, [("a", "x")]), path, buckets=2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: S.append_store(chunks_of(spark, [(f"p{n}", str(n))]), path), range(8)))
    assert texts(spark, path) == sorted([("a", "x")] + [(f"p{n}", str(n)) for n in range(8)])


def test_an_update_between_read_and_commit_of_another(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.create_store(chunks_of(spark, [("a", "1"), ("b", "1")]), path)
    add, once = S._add_part, []

    def late(*args):
        if not once:
            once.append(True)
            S.append_store(chunks_of(spark, [("c", "1")]), path)
        return add(*args)

    monkeypatch.setattr(S, "_add_part", late)
    S.update_store(chunks_of(spark, [("a", "2")]), path)
    assert texts(spark, path) == [("a", "2"), ("b", "1"), ("c", "1")]
    base = newest_number(spark, f"{path}/parts")
    S.append_store(chunks_of(spark, [("d", "1")]), path)
    with pytest.raises(VersionConflict):
        write_version(spark.createDataFrame([], S.PARTS), f"{path}/parts", base=base)
    assert [p for p in os.listdir(f"{path}/parts") if p.startswith(".new")] == []


def test_compaction_keeps_the_rows_beside_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.create_store(chunks_of(spark, [(f"p{n}", "1") for n in range(9)]), path, buckets=2)
    for n in range(4):
        S.update_store(chunks_of(spark, [(f"p{n}", "2")]), path, spark.createDataFrame([(f"p{n}",), (f"p{n + 1}",)], "path string"))
    want = texts(spark, path)
    assert want == [(f"p{n}", "2") for n in range(4)] + [(f"p{n}", "1") for n in range(5, 9)]
    write = S._write_data

    def and_others(*args):
        out = write(*args)
        monkeypatch.setattr(S, "_write_data", write)
        S.append_store(chunks_of(spark, [("new", "1")]), path)
        S.update_store(chunks_of(spark, [("p8", "3")]), path)
        return out

    monkeypatch.setattr(S, "_write_data", and_others)
    S.compact_store(spark, path, buckets=5)
    want = sorted([x for x in want if x[0] != "p8"] + [("new", "1"), ("p8", "3")])
    assert texts(spark, path) == want
    assert [part[2] for part in S._read_parts(spark, path) if part[4]] == [2] * sum(part[4] for part in S._read_parts(spark, path))
    S.compact_store(spark, path, buckets=5)
    assert texts(spark, path) == want
    assert {part[2] for part in S._read_parts(spark, path)} == {5} and not any(part[4] for part in S._read_parts(spark, path))
    S.vacuum_store(spark, path)
    assert texts(spark, path) == want
    S.update_store(chunks_of(spark, [("p7", "3")]), path)
    assert ("p7", "3") in texts(spark, path) and ("p7", "1") not in texts(spark, path)


def test_one_of_two_compactions_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.create_store(chunks_of(spark, [("a", "1"), ("b", "1")]), path)
    S.update_store(chunks_of(spark, [("a", "2")]), path)
    write = S._write_data

    def and_another(*args):
        out = write(*args)
        monkeypatch.setattr(S, "_write_data", write)
        S.compact_store(spark, path)
        return out

    monkeypatch.setattr(S, "_write_data", and_another)
    with pytest.raises(VersionConflict):
        S.compact_store(spark, path)
    assert texts(spark, path) == [("a", "2"), ("b", "1")]


def test_a_write_costs_what_changes(spark, tmp_path):
    path = str(tmp_path / "s")
    S.create_store(chunks_of(spark, [(f"p{n}", os.urandom(500).hex()) for n in range(3000)]), path, buckets=4)
    before = size(path)
    S.update_store(chunks_of(spark, [(f"p{n}", "new") for n in range(20)]), path)
    assert size(path) - before < 0.1 * before
    assert S.load_paths(spark, path, spark.createDataFrame([("p3",), ("none",)], "path string")).collect()[0].content == "new"


def test_late_documents_change_nothing(spark, tmp_path):
    def send(n, rows):
        folder = str(tmp_path / "in")
        made = spark.createDataFrame(rows, "path string, content string, at string")
        made = made.select("path", F.lit("f").alias("file_name"), F.lit(".md").alias("file_type"), F.lit(1).cast("long").alias("file_size"), "content",
                           F.to_timestamp("at").alias("processed_at"))
        made.select(*DOCUMENTS.names).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(DOCUMENTS).parquet(folder)
        query = ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return texts(spark, str(tmp_path / "store"))

    assert send(0, [("a", "first", "2026-01-02"), ("b", "b1", "2026-01-02")]) == [("a", "first"), ("b", "b1")]
    assert send(1, [("a", "late", "2026-01-01"), ("b", "b2", "2026-01-03")]) == [("a", "first"), ("b", "b2")]
    assert send(2, [("a", "newer", "2026-01-04")]) == [("a", "newer"), ("b", "b2")]


def arrive(spark, tmp_path, rows, **options):
    folder = str(tmp_path / "in")
    made = spark.createDataFrame(rows, "path string, content string, at string")
    made = made.select("path", F.lit("f").alias("file_name"), F.lit(".md").alias("file_type"), F.lit(1).cast("long").alias("file_size"), "content",
                       F.to_timestamp("at").alias("processed_at"))
    made.select(*DOCUMENTS.names).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    return texts(spark, str(tmp_path / "store"))


def test_a_stream_begins_with_what_the_store_holds(spark, tmp_path, monkeypatch):
    first = chunks_of(spark, [("a", "held"), ("b", "held"), ("c", "held")]).withColumn(
        "processed_at", F.when(F.col("path") != "c", F.to_timestamp(F.lit("2026-01-05"))))
    S.create_store(first, str(tmp_path / "store"))
    got = arrive(spark, tmp_path, [("a", "late", "2026-01-04"), ("b", "same time", "2026-01-05"), ("c", "any", "2020-01-01"), ("d", "new", None)])
    assert got == [("a", "held"), ("b", "same time"), ("c", "any"), ("d", "new")]
    # Later batches read nothing of the store.
    from passagemill.streaming import ingest as module
    monkeypatch.setattr(module, "load_store", None)
    got = arrive(spark, tmp_path, [("a", "late again", "2026-01-04"), ("b", "no time", None), ("d", "timed", "2019-01-01"), ("c", "older", "2019-12-31")])
    assert got == [("a", "held"), ("b", "no time"), ("c", "any"), ("d", "timed")]
    # A version without a time clears what was known of the path.
    assert ("b", "old") in arrive(spark, tmp_path, [("b", "old", "2001-01-01")])


def test_versions_of_one_batch(spark, tmp_path):
    rows = [("a", f"v{n}", f"2026-01-{n:02d}") for n in range(1, 9)] + [("a", None, "2025-01-01"), ("b", "y", "2026-01-01"), ("b", "x", "2026-01-01")]
    got = arrive(spark, tmp_path, rows)
    assert ("a", "v8") in got and len(got) == 2


def test_a_bucket_of_paths_asks_for_its_state_once():
    calls, held = [], []

    class State:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

    processor = NewestVersion()
    processor.newest = State()

    def batch(rows):
        frames = [pd.DataFrame(rows[n:n + 40], columns=["path", "content", "processed_micros"]).assign(bucket=1) for n in range(0, len(rows), 40)]
        return {(p, c) for out in processor.handleInputRows((1,), iter(frames), None) for p, c in zip(out["path"], out["content"])}

    first = [(f"p{n}", f"{day}", day) for day in (2, 1, 3, 2) for n in range(25)] + [(None, "none", 5)]
    assert batch(first) == {(f"p{n}", "3") for n in range(25)} | {(None, "none")}
    assert calls == ["get", "update"]
    assert batch([(f"p{n}", "late", 2) for n in range(10)] + [("p20", "untimed", None), ("null", "word", 1)]) == {("p20", "untimed"), ("null", "word")}
    assert batch([("p20", "old", 1), (None, "late", 4)]) == {("p20", "old")}


def test_stale_and_missing_files_leave_the_store(spark, tmp_path):
    root, store, manifest = tmp_path / "docs", str(tmp_path / "store"), str(tmp_path / "manifest")
    root.mkdir()
    for name in "abcd":
        (root / f"{name}.md").write_text(f"text {name}")
    (root / "t.csv").write_text("a,b\n1,2\n")
    ingest(spark, str(root), store, manifest)
    (root / "a.md").write_text("  \n")
    (root / "b.md").unlink()
    (root / "t.csv").write_text("")
    names = lambda: sorted(r.path.rsplit("/", 1)[-1] for r in load_store(spark, store).select("path").distinct().collect())
    ingest(spark, str(root), store, manifest)
    assert names() == ["b.md", "c.md", "d.md"]
    assert sorted(r.path.rsplit("/", 1)[-1] for r in read_manifest(spark, manifest).collect()) == ["b.md", "c.md", "d.md"]
    ingest(spark, str(root), store, manifest, drop_missing=True)
    assert names() == ["c.md", "d.md"]
    (root / "a.md").write_text("back")
    ingest(spark, str(root), store, manifest)
    assert names() == ["a.md", "c.md", "d.md"]


def test_a_run_over_a_changed_manifest_fails(spark, tmp_path):
    path = str(tmp_path / "m")
    write_manifest(read_manifest(spark, path), path)
    base = newest_number(spark, path)
    write_manifest(read_manifest(spark, path), path, base)
    with pytest.raises(VersionConflict):
        write_manifest(read_manifest(spark, path), path, base)
