"""Stored cells against all pairs, and which folders a search opens."""

import numpy as np
import pytest

from colloquy.operators import vector_store as vs


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], f"p{i}")
                                  for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, word string")


def exact(vectors, k, asked):
    x = np.array(vectors, dtype="float32").astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.rint(x @ x.T * 1e9) / 1e9
    return {i: [j for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j)) if j != i][:k] for i in asked}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.neighbour_id)
    return out


def test_only_visited_cells_are_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [c + 0.02 * rng.normal(size=16) for c in centres for _ in range(30)]
    path = str(tmp_path / "cells")
    vs.write_cells(frame(spark, vectors), path, payload=["word"], cells=40)
    asked = frame(spark, vectors).where("vec_id < 8")
    plans, read_cells = [], vs.read_cells

    def seen(*args):
        rows = read_cells(*args)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(vs, "read_cells", seen)
    top, read = vs.stored_topk(spark, path, asked, query_id="vec_id", exclude_self=True)
    assert found(top) == exact(vectors, 3, range(8))
    stored = {r["cell"] for r in read_cells(spark, path).select("cell").distinct().collect()}
    assert read < stored and len(read) <= len(stored) / 2
    assert all("PartitionFilters: [" in p and "PartitionFilters: []" not in p for p in plans)
    assert read_cells(spark, path).where("d = 7").first()["payload"]["word"] == "p7"


def test_even_vectors_copies_and_zeros(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [*rng.normal(size=(60, 4)), *[np.ones(4)] * 9, np.zeros(4), np.zeros(4)]
    path = str(tmp_path / "cells")
    vs.write_cells(frame(spark, [*vectors, None]), path)
    top, _ = vs.stored_topk(spark, path, frame(spark, [*vectors, None]), k=4, query_id="vec_id", exclude_self=True)
    assert found(top) == exact(vectors, 4, range(len(vectors)))


@pytest.mark.parametrize("vectors", [[], [[0.0, 0.0]], [[1.0, 2.0]]])
def test_small_tables(spark, tmp_path, vectors):
    path = str(tmp_path / "cells")
    vs.write_cells(frame(spark, vectors), path)
    top, _ = vs.stored_topk(spark, path, frame(spark, [[1.0, 1.0]]), query_id="vec_id")
    assert [len(v) for v in found(top).values()] == [1] * bool(vectors)
