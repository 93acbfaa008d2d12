import pytest
from pyspark.sql import functions as F

from passagemill import build_prompts, ingest, load_store, rebuild, reload_store, search
from passagemill.operators.changes import detect_changes, drop_missing, merge_manifest, replace_chunks
from passagemill.operators.filters import filter_changed
from passagemill.operators.status import store_info, store_status
from passagemill.schemas import DOCUMENTS, MANIFEST
from passagemill.sources.manifest import read_manifest, write_manifest
from passagemill.sources.store import (
    BUCKET_BYTES, BUCKETS, MOST_BUCKETS, append_store, bucket_count, create_store, store_exists, update_store, vacuum_store,
)
from passagemill.streaming.ingest import ingest_stream
from passagemill.streaming.search import search_stream

NOW = "to_timestamp('2026-01-01 00:00:00')"


def manifest_of(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string, size long").withColumn("processed_at", F.expr(NOW)).select(*MANIFEST.names)


def test_changes(spark):
    manifest = manifest_of(spark, [("a", "1", 1), ("b", "1", 1), ("gone", "1", 1)])
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    status = {r["path"]: r["status"] for r in detect_changes(files, manifest).collect()}
    assert status == {"a": "unchanged", "b": "changed", "c": "new", "gone": "missing"}
    assert {r["path"] for r in filter_changed(files, manifest).collect()} == {"b", "c"}
    assert {r["path"] for r in filter_changed(files, manifest.limit(0)).collect()} == {"a", "b", "c"}
    merged = merge_manifest(manifest, manifest_of(spark, [("b", "2", 9), ("c", "3", 7)]))
    assert {(r["path"], r["hash"], r["size"]) for r in merged.collect()} == {("a", "1", 1), ("gone", "1", 1), ("b", "2", 9), ("c", "3", 7)}
    assert {r["path"] for r in drop_missing(manifest, files).collect()} == {"a", "b"}


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    assert read_manifest(spark, path).count() == 0
    write_manifest(manifest_of(spark, [("a", "1", 1)]), path)
    for n in range(5):
        write_manifest(read_manifest(spark, path).withColumn("size", F.col("size") + 1), path)
    assert read_manifest(spark, path).first()["size"] == 6
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["v4", "v5", "v6"]
    # A version without its marker does not count.
    (tmp_path / "m" / "v6" / "_SUCCESS").unlink()
    assert read_manifest(spark, path).first()["size"] == 5


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "path string, chunk_no long, content string").withColumn(
        "chunk_id", F.concat_ws("#", "path", F.col("chunk_no").cast("string"))).withColumn("embedding", F.array(F.lit(1.0)))


def content(df):
    return sorted((r["path"], r["chunk_no"], r["content"]) for r in df.collect())


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    assert load_store(spark, path) is None and not store_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        append_store(chunks_of(spark, [("a", 0, "x")]), path)
    rows = [(f"p{i}", n, f"{i}.{n}") for i in range(20) for n in range(2)]
    create_store(chunks_of(spark, rows), path, buckets=4)
    before = load_store(spark, path)
    append_store(chunks_of(spark, [("new", 0, "n")]), path)
    assert content(before) == sorted(rows)
    assert content(reload_store(spark, path)) == sorted(rows + [("new", 0, "n")])
    changed = spark.createDataFrame([("p1",), ("p2",)], "path string")
    for _ in range(2):  # a repeated update changes nothing more
        update_store(chunks_of(spark, [("p1", 0, "fresh")]), path, changed)
        want = sorted([r for r in rows if r[0] not in ("p1", "p2")] + [("new", 0, "n"), ("p1", 0, "fresh")])
        assert content(load_store(spark, path)) == want
    vacuum_store(spark, path)
    assert content(load_store(spark, path)) == want
    info = store_info(load_store(spark, path)).first()
    assert (info["vectors"], info["documents"], info["dimension"]) == (len(want), 20, 1)


def test_bucket_count_follows_the_data():
    assert bucket_count(0) == BUCKETS and bucket_count(100 * BUCKET_BYTES - 1) == 100
    assert bucket_count(10**18) == MOST_BUCKETS


def test_store_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "s")
    create_store(chunks_of(spark, [("a", 0, "x")]), path)
    update_store(chunks_of(spark, []), path, spark.createDataFrame([("a",)], "path string"))
    assert load_store(spark, path).count() == 0
    append_store(chunks_of(spark, [("b", 0, "y")]), path)
    assert content(load_store(spark, path)) == [("b", 0, "y")]


def test_replace_chunks(spark):
    store = chunks_of(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")])
    assert content(replace_chunks(store, chunks_of(spark, [("a", 0, "new")]))) == [("a", 0, "new"), ("b", 0, "z")]


def test_ingest_rebuild_and_search(spark, tmp_path):
    root, store, manifest = tmp_path / "docs", str(tmp_path / "store"), str(tmp_path / "manifest")
    root.mkdir()
    with pytest.raises(ValueError):
        rebuild(spark, str(root), store, manifest)
    assert ingest(spark, str(root), store, manifest).documents == 0
    (root / "a.md").write_text("apples and pears " * 100)
    (root / "b.txt").write_text("trains and planes")
    (root / "t.csv").write_text("a,b\n1,2\n")
    (root / "blank.md").write_text(" \n")
    first = ingest(spark, str(root), store, manifest)
    assert first.documents == 3 and first.chunks > 3
    assert {r["path"].rsplit("/", 1)[-1] for r in read_manifest(spark, manifest).collect()} == {"a.md", "b.txt", "t.csv"}
    again = ingest(spark, str(root), store, manifest)
    assert (again.documents, again.chunks) == (0, 0)

    (root / "a.md").write_text("cherries")
    (root / "t.csv").write_text("a,b\n3,4\n")
    (root / "b.txt").unlink()
    second = ingest(spark, str(root), store, manifest)
    assert second.documents == 2
    rows = load_store(spark, store)
    texts = {r["path"].rsplit("/", 1)[-1]: r["content"] for r in rows.collect()}
    assert texts["a.md"] == "cherries" and texts["b.txt"] == "trains and planes" and "3" in texts["t.csv"]
    assert read_manifest(spark, manifest).count() == 3

    status = store_status(spark, store, manifest, str(root)).first()
    assert status["store_exists"] and status["store_loaded"] and status["manifest_exists"] and status["folder_exists"]

    asked = spark.createDataFrame([(1, "cherries", 1, None), (2, "planes", 2, "mmr"), (3, " ", 1, None)], "q_id long, query string, k int, search_type string")
    hits = {(r["q_id"], r["rank"]): r for r in search(asked, rows).collect()}
    assert hits[1, 1]["file_name"] == "a.md" and hits[1, 1]["distance"] < 1e-6
    assert hits[2, 1]["file_name"] == "b.txt" and (3, 1) not in hits and len(hits) == 3
    made, _ = build_prompts(asked, rows)
    assert "cherries" in {r["q_id"]: r["prompt"] for r in made.collect()}[1]

    result = rebuild(spark, str(root), store, manifest)
    assert result.documents == 2
    assert {r["path"].rsplit("/", 1)[-1] for r in reload_store(spark, store).collect()} == {"a.md", "t.csv"}


def test_failure_before_the_manifest_is_repeated(spark, tmp_path):
    root, store, manifest = tmp_path / "docs", str(tmp_path / "store"), str(tmp_path / "manifest")
    root.mkdir()
    (root / "a.md").write_text("one")

    def failing(df):
        raise RuntimeError("embedding service is down")

    with pytest.raises(RuntimeError):
        ingest(spark, str(root), store, manifest, embedder=failing)
    assert ingest(spark, str(root), store, manifest).documents == 1


def test_streams(spark, tmp_path):
    source, store, progress = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "progress")

    def arrive(rows):
        spark.createDataFrame(rows, "path string, content string").select(
            "path", F.col("path").alias("file_name"), F.lit(".md").alias("file_type"), F.lit(1).cast("long").alias("file_size"),
            "content", F.expr(NOW).alias("processed_at")).write.mode("append").parquet(source)

    def run():
        ingest_stream(spark.readStream.schema(DOCUMENTS).parquet(source), store, progress).awaitTermination()
        return {r["path"]: r["content"] for r in load_store(spark, store).collect()}

    arrive([("a", "apples"), ("b", "trains")])
    assert run() == {"a": "apples", "b": "trains"}
    arrive([("b", "ships")])
    assert run() == {"a": "apples", "b": "ships"}

    bodies, output = str(tmp_path / "bodies"), str(tmp_path / "hits")
    spark.createDataFrame([(1, '{"query": "ships", "k": 1}'), (2, "nope")], "q_id long, body string").write.parquet(bodies)
    search_stream(spark.readStream.schema("q_id long, body string").parquet(bodies), store, output, str(tmp_path / "p2")).awaitTermination()
    hits = spark.read.parquet(f"{output}/batch=*").collect()
    assert [(r["q_id"], r["content"]) for r in hits] == [(1, "ships")]
