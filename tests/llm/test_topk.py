import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitscope.llm import topk


def brute(rows, k, scale=64):
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, tuple(math.floor(scale * x) for x in v)))
    out = []
    for q, v in sorted({(i, v) for i, v in vectors if i % 5 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "MIN_BLOCK", 16)
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(rng.choice((6, 6, 4)))]) for i in range(90)]
    rows += [(i, [0.25, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 140)]  # ties
    rows += [(3, rows[3][1]), (5, rows[5][1]), (141, None), (142, [1.0, None]), (143, [float("nan")]),
             (144, [float("inf"), 1.0]), (None, [1.0] * 6), (145, []), (150, [0.0] * 6)]
    docs = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows],
                                 "vec_id long, embedding array<double>, id int, rank int, score string")
    got = topk.top_k(docs, F.col("vec_id") % 5 == 0, k=k)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, k)


def test_block_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (3000, 16)) * rng.integers(1, 20, (3000, 1))
    ids = rng.permutation(3000)
    basis = topk.rotation(x.T.astype(float) @ x)
    assert np.allclose(basis.T @ basis, np.eye(16))
    block = topk.Block(ids, x, basis, 4)
    row, found, score = block.search(ids[:9], x[:9], basis, 5, np.full(9, topk.NO_SCORE), np.full(9, topk.NO_ID))
    for q in range(9):
        s = x @ x[q]
        want = sorted((-int(s[j]), int(ids[j])) for j in range(3000) if ids[j] != ids[q])[:5]
        assert [(-int(a), int(b)) for a, b in zip(score[row == q], found[row == q])] == want
    large = np.array([[2**40, 1], [2**40, 3]], dtype=np.int64)  # beyond exact floats
    row, found, score = topk.Block(np.array([1, 2]), large, np.eye(2), 1).search(
        np.array([9]), np.array([[2**20, 1]]), np.eye(2), 2, np.full(1, topk.NO_SCORE), np.full(1, topk.NO_ID))
    assert list(zip(found, score)) == [(2, 2**60 + 3), (1, 2**60 + 1)]
    # What ranks after the floor isn't found: equal scores only with a smaller id.
    for floor_id, want in ((2, [2]), (1, [2]), (3, [2])):
        row, found, score = topk.Block(np.array([1, 2]), large, np.eye(2), 1).search(
            np.array([9]), np.array([[2**20, 1]]), np.eye(2), 2, np.array([2**60 + 1]), np.array([floor_id]))
        assert list(found) == (want + [1] if floor_id > 1 else want)


def test_rounds_leave_out_blocks_of_short_vectors(spark, monkeypatch):
    """Lengths from 1 to 1,000: after the first rounds no query is sent on."""
    monkeypatch.setattr(topk, "MIN_BLOCK", 8)
    searched = []
    plain = topk.Workspace.stage
    monkeypatch.setattr(topk.Workspace, "stage", lambda self, df, name: (searched.append(name), plain(self, df, name))[1])
    rng = random.Random(1)
    rows = [(i, [rng.random() + 0.5 for _ in range(4)]) for i in range(400)]
    rows = [(i, [x * 0.95 ** i for x in v]) for i, v in rows]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(docs, F.col("vec_id") % 5 == 0, k=3, scale=2.0 ** 20)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 2 ** 20)
    assert [name for name in searched if name.startswith("best-")] == ["best-0", "best-1", "best-4"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(lone, F.col("vec_id") == 0).count() == 0
    assert topk.top_k(lone, F.lit(None).cast("boolean")).count() == 0
