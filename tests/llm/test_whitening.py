"""Whitening against a plain eigen-decomposition."""

import numpy as np
import pytest

from commitscope.llm import queries, whitening
from commitscope.llm.common import Workspace

from .conftest import SF


def brute(x, k=8):
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, centred @ vectors[:, :k] / np.sqrt(values[:k]), ((n * x - total) ** 2).sum(axis=1)


def table(spark, vectors, kind="float"):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_table_against_eigenvectors(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(source.embedding).astype(float)).astype(np.int64) + 100000
    values, z, off = brute(x)
    got = by_id(queries.QUERIES["op12_whitening"](spark, SF).collect())
    assert len(got) == len(x)
    found = np.array([[got[i][c].whitened for c in range(1, 9)] for i in source.vec_id])
    assert np.abs(found * np.sign((found * z).sum(axis=0)) - z).max() < 1e-9
    first = got[source.vec_id[0]]
    assert np.allclose([first[c].explained for c in range(1, 9)], values[:8] / values.sum(), rtol=1e-12)
    assert [got[i][1].deviation for i in source.vec_id] == off.tolist()
    assert first[1].identity_error < 1e-10 and {r.n for c in got.values() for r in c.values()} == {len(x)}


def test_rows_that_drop_out_and_repeats(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 5))
    odd = [None, [], [1, 2, None, 3, 4], [1, float("nan"), 1, 1, 1], [float("inf")] * 5, [1e300] * 5, [1.0, 2.0]]
    data = table(spark, [*good, *odd, good[0], good[0]], "double")
    extra = data.selectExpr("vec_id", "embedding", "1 AS x", "2 AS n", "3 AS component")
    extra = extra.unionByName(extra.filter("vec_id = 3").selectExpr("cast(null AS long) vec_id", "embedding", "x", "n", "component"))
    got = whitening.whiten(extra).collect()
    x = np.floor(1024 * np.array([*good, good[0], good[0], good[3]])).astype(np.int64) + 100000
    assert {r.n for r in got} == {43} and len(got) == 43 * 5
    off = dict(zip([*range(40), 47, 48, None], brute(x, 5)[2].tolist()))
    assert all(r.deviation == off[r.vec_id] and r.deviation_digits == str(off[r.vec_id]) for r in got)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None], [[]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_few_directions_ties_and_tiny_ones(spark):
    # Two directions of five; each of the first two eigenvalues is there twice.
    flat = [[a, b, 0, 0, 0] for a in (0, 1) for b in (0, 2)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-12
    square = [[s * 4 * (k == i) for k in range(4)] for i in range(4) for s in (1, -1)]
    got = whitening.whiten(table(spark, square)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4}
    assert max(r.identity_error for r in got) < 1e-12
    assert np.allclose([r.explained for r in got], 0.25)
    rng = np.random.default_rng(3)
    steep = rng.normal(size=(300, 6)) * 10.0 ** -np.arange(0, 3, 0.5)
    got = by_id(whitening.whiten(table(spark, steep, "double")).collect())
    z = brute(np.floor(1024 * steep).astype(np.int64) + 100000, 6)[1]
    found = np.array([[got[i][c].whitened for c in range(1, 7)] for i in range(300)])
    assert np.abs(found * np.sign((found * z).sum(axis=0)) - z).max() < 1e-8


def test_deviation_beyond_a_long(spark):
    got = whitening.whiten(table(spark, [[1e9, 0], [-1e9, 3], [0, 1]], "double")).collect()
    x = [(int(a * 1024) + 100000, int(b * 1024) + 100000) for a, b in ((1e9, 0), (-1e9, 3), (0, 1))]
    total = [sum(c) for c in zip(*x)]
    want = {k: sum((3 * a - t) ** 2 for a, t in zip(v, total)) for k, v in enumerate(x)}
    assert all(int(r.deviation_digits) == want[r.vec_id] for r in got) and want[0] > 2 ** 63
    assert all((r.deviation is None) == (want[r.vec_id] >= 2 ** 63) for r in got)


def test_fit_uses_no_more_steps_than_the_rows_need(spark):
    x = whitening.integers(table(spark, [[k % 7, 2 * (k % 7), 5] for k in range(50)]))
    model = whitening.fit(whitening._blocks(x, Workspace(spark, "test")), 3)
    assert model.steps <= 2 and model.components.shape == (3, 1)
