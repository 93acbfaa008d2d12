"""Search over metric cells gives what a full scan gives."""

import numpy as np
import pytest

from passagemill.operators import cells as C
from passagemill.operators.search import knn_batch
from test_search import ASKED, STORE, ranked


def stored(spark, vectors):
    rows = [(f"c{i:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, STORE).repartition(3)


def asked(spark, vectors, wanted):
    rows = [(i, None if v is None else [float(x) for x in v], k, 0, 0.5) for i, (v, k) in enumerate(zip(vectors, wanted))]
    return spark.createDataFrame(rows, ASKED)


def vectors_of(kind, rng):
    if kind == "clustered":
        centres = rng.normal(size=(12, 6)) * 50
        return np.concatenate([c + rng.normal(size=(25, 6)) for c in centres]), centres[:9] + rng.normal(size=(9, 6))
    if kind == "tied":
        # Few distinct points, on a grid, so that radii and distances are equal.
        return rng.integers(-1, 2, size=(300, 3)).astype(float), rng.integers(-1, 2, size=(9, 3)).astype(float)
    # Points on a sphere around the requests, and some far apart in size: no cell can be left out, or rounding is tight.
    points = rng.normal(size=(300, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[250:] *= np.logspace(-3, 6, 50)[:, None]
    return points, np.concatenate([np.zeros((3, 4)), rng.normal(size=(6, 4)) * 1e-6 + points[:6]])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["clustered", "tied", "adversarial"])
def test_cells_equal_the_full_scan(spark, tmp_path, kind, metric):
    rng = np.random.default_rng(7)
    vectors, queries = vectors_of(kind, rng)
    vectors = [*vectors, None, np.zeros(vectors.shape[1]), [np.nan] * vectors.shape[1]]
    store = stored(spark, vectors)
    C.write_cells(store, str(tmp_path / "cells"), metric, cells=20)
    requests = asked(spark, [*queries, None, np.zeros(queries.shape[1])], [1, 3, 5, 8, 20, 25, 26, 299, 1000, 5, 4])
    want = ranked(knn_batch(requests, store, metric))
    assert ranked(C.knn_cells(requests, str(tmp_path / "cells"), metric)) == want
    blocks = C.knn_cells(requests, str(tmp_path / "cells"), metric, broadcast_bytes=8 * queries.shape[1] * 3)
    assert ranked(blocks) == want


def test_few_cells_are_read_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors, queries = vectors_of("clustered", rng)
    C.write_cells(stored(spark, vectors), str(tmp_path / "cells"), cells=40)
    # The requests lie in three of twelve clusters.
    requests = asked(spark, queries[:3], [5, 5, 5])
    read = C.cells_read(requests, str(tmp_path / "cells")).first()
    assert read.n_rows == 300 and 0 < read.rows_read <= 100 and read.cells_read < read.cells
    needed = C.plan_cells(requests, str(tmp_path / "cells")).collect()
    assert all(len(r.cells) < 15 for r in needed)
    cells = sorted({c for r in needed for c in r.cells})
    plan = C.read_cells(spark, str(tmp_path / "cells"), cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_many_rows_are_left_to_the_full_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    vectors, queries = vectors_of("clustered", rng)
    store = stored(spark, vectors)
    C.write_cells(store, str(tmp_path / "cells"), cells=10)
    monkeypatch.setattr(C, "STATE_K", 6)
    requests = asked(spark, queries[:4], [2, 6, 7, 400])
    assert ranked(C.knn_cells(requests, str(tmp_path / "cells"))) == ranked(knn_batch(requests, store))


def test_empty_sides_and_other_metrics(spark, tmp_path):
    store = stored(spark, [(1.0, 2.0), (3.0, 4.0)])
    C.write_cells(store, str(tmp_path / "some"))
    assert C.knn_cells(asked(spark, [None], [3]), str(tmp_path / "some")).count() == 0
    assert C.knn_cells(asked(spark, [(1, 1)], [0]), str(tmp_path / "some")).count() == 0
    C.write_cells(store.limit(0), str(tmp_path / "none"))
    assert C.knn_cells(asked(spark, [(1, 1)], [3]), str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no cells for the metric"):
        C.write_cells(store, str(tmp_path / "dot"), "dot")
