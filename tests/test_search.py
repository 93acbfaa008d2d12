import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import vectors as V
from passagemill.operators import search as S
from passagemill.operators.search import knn_batch, knn_topk, mmr, rank_long

STORE = "chunk_id string, embedding array<float>"
ASKED = "q_id long, embedding array<double>, k int, fetch_k int, lambda_mult double"


def store_of(spark, vectors):
    return spark.createDataFrame([(f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)], STORE)


def requests_of(spark, vectors, k=5, fetch_k=15, weight=0.5):
    return spark.createDataFrame([(i, [float(x) for x in v], k, fetch_k, weight) for i, v in enumerate(vectors)], ASKED)


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["q_id"], []).append((r["rank"], r["chunk_id"], r["distance"]))
    return {q: sorted(rows) for q, rows in out.items()}


def brute(queries, vectors, k, metric):
    vectors = np.asarray(vectors, dtype=np.float32).astype(float)
    out = {}
    for n, q in enumerate(np.asarray(queries, dtype=float)):
        if metric == "l2":
            d = ((vectors - q) ** 2).sum(axis=1)
        elif metric == "dot":
            d = -(vectors @ q)
        else:
            d = 1 - (vectors @ q) / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(q))
        order = sorted(range(len(d)), key=lambda i: (round(d[i], 9), i))[:k]
        out[n] = [(r + 1, f"c{i:04d}", d[i]) for r, i in enumerate(order)]
    return out


def same(got, want):
    assert {q: [row[:2] for row in rows] for q, rows in got.items()} == {q: [row[:2] for row in rows] for q, rows in want.items()}
    for q, rows in want.items():
        assert np.allclose([r[2] for r in got[q]], [r[2] for r in rows], atol=1e-9)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[200:230] = vectors[100:130]  # exact copies: ties go to the lower id
    return rng.normal(size=(12, 8)), vectors


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_equals_brute_force(spark, data, metric):
    queries, vectors = data
    store = store_of(spark, vectors).repartition(5)
    same(ranked(knn_batch(requests_of(spark, queries), store, metric)), brute(queries, vectors, 5, metric))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_request_blocks_equal_brute_force(spark, data, metric):
    queries, vectors = data
    got = knn_batch(requests_of(spark, queries), store_of(spark, vectors), metric, broadcast_bytes=8 * 8 * 5)
    same(ranked(got), brute(queries, vectors, 5, metric))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_bounds_from_shares_change_nothing(spark, data, metric, monkeypatch):
    """Shares of one split in four and in two bound the distances; some hold fewer rows than are wanted."""
    queries, vectors = data
    monkeypatch.setattr(S, "_splits", lambda rows: 5000)
    monkeypatch.setattr(S, "SHARES", (4, 2))
    store = store_of(spark, vectors).repartition(5)
    for k in (5, 130):
        same(ranked(knn_batch(requests_of(spark, queries, k=k), store, metric)), brute(queries, vectors, k, metric))
    if metric == "l2":
        monkeypatch.setattr(S, "RANK_K", 4)
        monkeypatch.setattr(S, "STATE_K", 6)
        same(ranked(knn_batch(requests_of(spark, queries, k=7), store, metric)), brute(queries, vectors, 7, metric))


def test_emitted_rows_do_not_grow_with_the_splits(spark):
    rng = np.random.default_rng(1)
    store = S._located(store_of(spark, rng.normal(size=(1600, 4))))
    requests = requests_of(spark, rng.normal(size=(4, 4)), k=5).withColumn("carry", F.lit(False)).withColumn("k", F.col("k").cast("long"))
    schema = S._candidate_schema(requests, store)
    block = S._as_block(requests.select("q_id", "embedding", "k", "carry").toArrow(), 4)
    emitted = {}
    for splits in (8, 32):
        rows = store.repartition(splits, "chunk_id")
        plain = S._scan_candidates(block, rows, schema, "l2").count()
        bound = S._bounded(block, rows, schema, "l2", 5, [4])
        emitted[splits] = plain, S._scan_candidates(bound, rows, schema, "l2").count()
    assert emitted[32][0] == 4 * emitted[8][0] == 640 and emitted[32][1] < 1.5 * emitted[8][1] + 40 < 320


def test_mixed_k_and_long_results(spark, data, monkeypatch):
    queries, vectors = data
    monkeypatch.setattr(S, "RANK_K", 10)
    monkeypatch.setattr(S, "STATE_K", 40)
    wanted = [3, 10, 25, 60, 299, 1000, 0, -1, 1, 11, 41, 300]
    requests = requests_of(spark, queries).drop("k").join(
        spark.createDataFrame(list(enumerate(wanted)), "q_id long, k int"), "q_id")
    got = ranked(knn_batch(requests, store_of(spark, vectors).repartition(4)))
    full = brute(queries, vectors, 300, "l2")
    same(got, {q: full[q][:k] for q, k in enumerate(wanted) if k > 0})


def test_small_state_blocks(spark, data, monkeypatch):
    queries, vectors = data
    monkeypatch.setattr(S, "STATE_ROWS", 11)
    same(ranked(knn_batch(requests_of(spark, queries), store_of(spark, vectors))), brute(queries, vectors, 5, "l2"))


def test_many_small_steps(spark, data, monkeypatch):
    queries, vectors = data
    monkeypatch.setattr(S, "SCORE_CELLS", 36)
    monkeypatch.setattr(S, "EXACT_PAIRS", 7)
    same(ranked(knn_batch(requests_of(spark, queries), store_of(spark, vectors).coalesce(1))), brute(queries, vectors, 5, "l2"))


def test_one_vector(spark, data):
    queries, vectors = data
    for metric in ("l2", "cosine", "dot"):
        got = knn_topk(list(queries[0]), store_of(spark, vectors), 7, metric).collect()
        want = brute(queries[:1], vectors, 7, metric)[0]
        assert [(r["rank"], r["chunk_id"]) for r in got] == [w[:2] for w in want]


def test_one_vector_for_very_many_rows(spark, data, monkeypatch):
    queries, vectors = data
    monkeypatch.setattr(S, "RANK_K", 20)
    got = knn_topk(list(queries[0]), store_of(spark, vectors), 170)
    want = brute(queries[:1], vectors, 170, "l2")[0]
    assert sorted((r["rank"], r["chunk_id"]) for r in got.collect()) == [w[:2] for w in want]


def test_known_order_in_the_plane(spark):
    store = store_of(spark, [(0, 1), (1, 0), (2, 0), (-1, 0)])
    got = ranked(knn_batch(requests_of(spark, [(1, 0)], k=3), store))
    assert got[0] == [(1, "c0001", 0.0), (2, "c0002", 1.0), (3, "c0000", 2.0)]


def test_zero_vectors_rank_last_under_cosine(spark):
    store = store_of(spark, [(0, 0), (1, 0), (-1, 0)])
    got = ranked(knn_batch(requests_of(spark, [(1, 0)]), store, "cosine"))
    assert got[0] == [(1, "c0001", 0.0), (2, "c0002", 2.0), (3, "c0000", None)]
    one = knn_topk([1.0, 0.0], store, 3, "cosine").collect()
    assert [r["chunk_id"] for r in one] == ["c0001", "c0002", "c0000"] and one[2]["distance"] is None


def test_undefined_requests_and_rows_among_others(spark, data, monkeypatch):
    queries, vectors = data[0].copy(), data[1].copy()
    queries[3], vectors[7], vectors[11] = 0, 0, np.nan
    monkeypatch.setattr(S, "SCORE_CELLS", 500)
    got = ranked(knn_batch(requests_of(spark, queries, k=299), store_of(spark, vectors), "cosine"))
    assert [row[1:] for row in got[3]] == [(f"c{i:04d}", None) for i in range(299)]
    assert [row[1] for row in got[0]][-1] == "c0007" and got[0][-1][2] is None
    clean = np.delete(np.arange(300), [7, 11])
    want = brute(queries[:1], vectors[clean], 298, "cosine")[0]
    assert [row[1] for row in got[0]][:298] == [f"c{clean[int(w[1][1:])]:04d}" for w in want]


def test_empty_sides(spark):
    store, requests = store_of(spark, [(1, 0)]), requests_of(spark, [(1, 0)])
    assert knn_batch(requests, store.limit(0)).count() == 0
    assert knn_batch(requests.limit(0), store).count() == 0
    assert mmr(requests, store.limit(0)).count() == 0
    assert mmr(requests.limit(0), store).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 32}])
def test_missing_vectors_take_no_part(spark, options):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], STORE)
    asked = spark.createDataFrame([(n, None if n == 1 else [1.0, 0.0], 5, 5, 0.5) for n in range(4)], ASKED)
    got = ranked(knn_batch(asked, store, **options))
    assert set(got) == {0, 2, 3} and [row[1] for row in got[2]] == ["a", "c"]
    assert knn_batch(asked, store.where("embedding is null"), **options).count() == 0
    assert knn_batch(asked.where("embedding is null"), store, **options).count() == 0
    assert set(ranked(mmr(asked, store, **options))) == {0, 2, 3}


def test_wrong_dimension_and_metric_fail(spark):
    with pytest.raises(Exception, match="2 entries"):
        knn_batch(requests_of(spark, [(1, 0)]), store_of(spark, [(1, 0, 0)])).collect()
    with pytest.raises(Exception, match="unknown metric"):
        knn_batch(requests_of(spark, [(1, 0)]), store_of(spark, [(1, 0)]), "cube").collect()


def test_hot_request_ranks_in_slices(spark):
    schema = "q_id long, chunk_id string, distance double, k long"
    rows = [(1, f"c{i:05d}", float(i % 997), 50) for i in range(5000)] + [(2, "c00001", 1.0, 3)]
    for rank in (S.rank_hits, rank_long):
        got = ranked(rank(spark.createDataFrame(rows, schema)))
        want = sorted(rows[:5000], key=lambda r: (r[2], r[1]))[:50]
        assert [r[1] for r in got[1]] == [w[1] for w in want]
        assert got[2] == [(1, "c00001", 1.0)]


def mmr_brute(query, vectors, order, k, weight):
    def cos(a, b):
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / scale if scale else 0.0

    left, chosen = list(order), []
    while left and len(chosen) < k:
        def score(i):
            if not chosen:
                return cos(query, vectors[i])
            return weight * cos(query, vectors[i]) - (1 - weight) * max(cos(vectors[i], vectors[c]) for c in chosen)
        best = max(left, key=lambda i: (round(score(i), 12), -order.index(i)))
        chosen.append(best)
        left.remove(best)
    return chosen


@pytest.mark.parametrize("group_bytes, ahead", [(S.MMR_GROUP_BYTES, S.MMR_AHEAD), (8 * 8 * 3, S.MMR_AHEAD), (8 * 8 * 3, 3), (8 * 8 * 3, 1)])
@pytest.mark.parametrize("weight", [0.0, 0.3, 0.5, 1.0])
def test_mmr_equals_brute_force(spark, data, weight, group_bytes, ahead):
    queries, vectors = data[0][:3], data[1]
    got = ranked(mmr(requests_of(spark, queries, 4, 12, weight), store_of(spark, vectors), group_bytes=group_bytes, ahead=ahead))
    near = brute(queries, vectors, 12, "l2")
    for q, query in enumerate(queries):
        order = [int(row[1][1:]) for row in near[q]]
        want = mmr_brute(query, vectors.astype(float), order, 4, weight)
        assert [row[1] for row in got[q]] == [f"c{i:04d}" for i in want]


def test_mmr_avoids_a_copy_and_is_bounded_by_fetch_k(spark):
    store = store_of(spark, [(1, 0.1), (1, 0.1), (0.8, -0.6), (0, 1)])
    got = ranked(mmr(requests_of(spark, [(1, 0)], k=2, fetch_k=4), store))
    assert got[0][0][1] == "c0000" and got[0][1][1] != "c0001"
    assert len(ranked(mmr(requests_of(spark, [(1, 0)], k=9, fetch_k=2), store))[0]) == 2
    assert len(ranked(mmr(requests_of(spark, [(1, 0)], k=9, fetch_k=99), store))[0]) == 4


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 2.0])], "a array<double>, z array<double>, b array<float>").select(
        V.l2_squared(F.col("a"), F.col("b")).alias("l2"), V.dot(F.col("a"), F.col("b")).alias("dot"), V.norm(F.col("a")).alias("norm"),
        V.cosine(F.col("a"), F.col("z")).alias("none"), V.normalise(F.col("a")).alias("unit"), V.normalise(F.col("z")).alias("zero"),
    ).first()
    assert (row["l2"], row["dot"], row["norm"], row["none"], row["unit"]) == (8.0, 11.0, 5.0, None, [0.6, 0.8])
    assert row["zero"] == [None, None]


def test_no_cross_join_in_the_plan(spark, data):
    queries, vectors = data
    plan = knn_batch(requests_of(spark, queries), store_of(spark, vectors))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ids_of_other_types(spark):
    store = spark.createDataFrame([(7, [1.0]), (3, [1.0]), (5, [2.0])], T.StructType([
        T.StructField("chunk_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = knn_batch(requests_of(spark, [(1,)], k=3), store).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [3, 7, 5]


@given(st.integers(0, 2**31), st.integers(1, 9), st.integers(1, 12), st.sampled_from([0.0, 0.25, 0.5, 1.0]))
@settings(max_examples=200, deadline=None)
def test_mmr_helper_properties(seed, k, n, weight):
    rng = np.random.default_rng(seed)
    # Few distinct directions, so copies and ties are common.
    rows = rng.integers(-1, 2, size=(n, 3)).astype(float)
    query = rng.integers(-1, 2, size=3).astype(float)
    picks = S._mmr_picks(query, rows, k, weight)
    assert len(picks) == min(k, n) == len(set(picks))
    if weight == 1.0:
        lengths = np.linalg.norm(rows, axis=1) * np.linalg.norm(query)
        cosines = np.divide(rows @ query, lengths, out=np.zeros(n), where=lengths > 0)
        chosen = [round(c, 9) for c in cosines[picks]]
        assert chosen == sorted(chosen, reverse=True)


def test_sparse_search_counts_shared_terms(spark):
    chunks = spark.createDataFrame([("a", "red red blue"), ("b", "blue"), ("c", "green"), ("d", "")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "Red", 4)], "q_id long, query string, k int")
    got = S.sparse_search(asked, chunks, dim=4096).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b", "c", "d"]
    assert abs(got[0]["distance"] - (1 - 2 / 5**0.5)) < 1e-12 and got[1]["distance"] == 1.0 and got[3]["distance"] is None


def files_read(df):
    """Files that the scans of a finished query have opened."""
    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            yield from walk(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            yield node.metrics().apply("numFiles").value()
        else:
            children = node.children()
            for n in range(children.size()):
                yield from walk(children.apply(n))

    df.collect()
    return sorted(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """A store of twelve files."""
    from passagemill.sources.store import as_store

    rng = np.random.default_rng(2)
    rows = [(f"c{i:04d}", [float(x) for x in rng.normal(size=4)], f"text {i}", f"/p/{i}") for i in range(240)]
    df = as_store(spark.createDataFrame(rows, "chunk_id string, embedding array<float>, content string, path string"))
    path = str(tmp_path_factory.mktemp("stores") / "store")
    df.repartitionByRange(12, "chunk_id").write.parquet(path)
    return spark.read.parquet(path)


def test_one_scan_serves_both_search_types(spark, saved, monkeypatch):
    from passagemill.plans.search import rank_requests

    rng = np.random.default_rng(4)
    rows = [(n, [float(x) for x in rng.normal(size=4)], 3 + n, 9 + n, 0.4, "mmr" if n % 2 else "similarity") for n in range(8)]
    ready = spark.createDataFrame(rows, ASKED + ", search_type string")
    scans = []
    whole = S._scan_candidates
    monkeypatch.setattr(S, "_scan_candidates", lambda *a, **b: scans.append(a) or whole(*a, **b))
    got = rank_requests(ready, saved)
    assert len(scans) == 1
    assert got.columns == ["q_id", "rank", "chunk_id", "distance", "file"]
    both = ranked(got.drop("file"))
    monkeypatch.undo()
    assert {q: both[q] for q in both if q % 2} == ranked(mmr(ready.where("search_type = 'mmr'"), saved))
    assert {q: both[q] for q in both if not q % 2} == ranked(knn_batch(ready.where("search_type = 'similarity'"), saved))


def test_text_is_read_from_the_files_of_the_hits(spark, saved, tmp_path):
    from passagemill.session import keep

    one = saved.where("chunk_id = 'c0101'").first()
    requests = requests_of(spark, [one.embedding], k=1)
    hits = keep(S.nearest(requests, saved).drop("vector"), "hits")
    found = S.attach_content(hits, saved, requests)
    assert [(r.chunk_id, r.content) for r in found.collect()] == [("c0101", "text 101")]
    assert files_read(S.attach_content(hits, saved, requests))[0] == 1
    # Hits without a known file, and rows that come from no file.
    assert S.attach_content(hits.drop("file"), saved, requests).count() == 1
    store = spark.createDataFrame(saved.limit(5).collect(), saved.schema)
    hits = keep(S.nearest(requests, store).drop("vector"), "hits")
    assert hits.first().file is None and S.attach_content(hits, store, requests).count() == 1


def test_carried_vectors_are_those_of_the_hits(spark, saved, monkeypatch):
    rng = np.random.default_rng(6)
    asked = requests_of(spark, rng.normal(size=(6, 4)), k=7).withColumn("carry", F.col("q_id") % 2 == 0)
    vectors = {r.chunk_id: r.embedding for r in saved.collect()}
    for cells, state in ((S.SCORE_CELLS, S.STATE_K), (50, S.STATE_K), (50, 3)):
        monkeypatch.setattr(S, "SCORE_CELLS", cells)
        monkeypatch.setattr(S, "STATE_K", state)
        rows = S.nearest(asked, saved).collect()
        assert len(rows) == 42
        assert all((r.vector is None) if r.q_id % 2 else r.vector == vectors[r.chunk_id] for r in rows)


def held_by(asked, rows, wanted, metric="l2", parts=3):
    """Request, distance and row number of what a task keeps, brute force beside it."""
    block = S.Block(pa.array(np.arange(len(asked))), asked, np.full(len(asked), wanted), np.zeros(len(asked), bool), np.full(len(asked), np.inf))
    best = S.BestRows(block, metric)
    for numbers in np.array_split(np.arange(len(rows)), parts):
        best.add(S.Part(pa.array(numbers), pa.nulls(len(numbers), pa.int64()), rows[numbers].astype(np.float32)))
    return best, best.compact().sort_by([("q", "ascending"), ("d", "ascending"), ("id", "ascending")])


def test_many_requests_are_scored_in_squares(monkeypatch):
    """However many requests a block has, a piece of the store is no sliver of a few rows."""
    rng = np.random.default_rng(3)
    asked, rows = rng.normal(size=(512, 8)), rng.normal(size=(300, 8))
    monkeypatch.setattr(S, "SCORE_CELLS", 4096)
    sizes, lengths = [], S._lengths
    monkeypatch.setattr(S, "_lengths", lambda x: (sizes.append(len(x)), lengths(x))[1])
    _, table = held_by(asked, rows, 4)
    assert max(n for n in sizes if n < 300) == 64
    away = ((rows.astype(np.float32).astype(float)[None] - asked[:, None]) ** 2).sum(axis=2)
    assert table["id"].to_pylist() == np.argsort(away, axis=1)[:, :4].reshape(-1).tolist()


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("size", [1e-20, 1.0, 1e9, 1e80])
def test_rows_and_requests_of_any_length(metric, size):
    rng = np.random.default_rng(4)
    asked, rows = rng.normal(size=(40, 5)) * size, rng.normal(size=(200, 5)) * min(size, 1e12)
    _, table = held_by(asked, rows, 6, metric)
    rows = rows.astype(np.float32).astype(float)
    if metric == "l2":
        away = ((rows[None] - asked[:, None]) ** 2).sum(axis=2)
    else:
        away = -(asked @ rows.T)
        if metric == "cosine":
            away = 1 + away / np.sqrt((asked**2).sum(axis=1))[:, None] / np.sqrt((rows**2).sum(axis=1))
    assert np.allclose(table["d"].to_numpy().reshape(40, 6), np.sort(away, axis=1)[:, :6], rtol=1e-9, atol=1e-12 if metric == "cosine" else 0)


def test_a_request_without_direction_holds_what_it_wants(monkeypatch):
    """It is equally far from all rows: those of the least ids are kept, not every row of the part."""
    held, hold = [], S.BestRows._hold
    monkeypatch.setattr(S.BestRows, "_hold", lambda self, q, *rest: (held.append(np.bincount(q, minlength=2)[1]), hold(self, q, *rest))[1])
    rng = np.random.default_rng(5)
    _, table = held_by(np.array([[1.0, 0, 0], [0, 0, 0]]), rng.normal(size=(600, 3)), 4, "cosine")
    assert sum(held) <= 3 * 4 and table["id"].to_pylist()[4:] == [0, 1, 2, 3]


def test_ties_are_cut_by_id():
    rows = np.repeat(np.eye(3), 40, axis=0)[::-1]
    best, table = held_by(np.eye(3) * 2, rows, 5)
    assert table["id"].to_pylist() == [80, 81, 82, 83, 84, 40, 41, 42, 43, 44, 0, 1, 2, 3, 4]
    assert best.n_held == 15
