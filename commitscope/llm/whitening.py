"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, the method alternates the products Xv and Xᵀu and
orthogonalises each new u and v against all earlier ones.  A u has an entry
per row; it is never stored: every u lies in the range of X, so the driver
keeps the d coefficients c with u = Xc, and tasks rebuild their entries of u
from their own rows.  One pass over the rows gives Xv, its products with all
earlier u (the reorthogonalisation) and Xᵀ of it; d-vectors and sums come
back, nothing that grows with the rows.

The small matrix UᵀXV (bidiagonal, but where the space was exhausted and a
fresh v was taken) then has the singular values and right vectors of X on the
space of all v.  Steps end when that space holds all of the rows' energy, and
at d steps at the latest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Workspace, quoted

BLOCK_ENTRIES = 1 << 16  # of the matrix, in a row of the staged table
LARGEST = 1 << 52  # integers up to here are exact doubles


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0,
             shift: int = 100000) -> DataFrame:
    """``vec_id, x array<long>``: each entry c, as a double, becomes
    floor(scale * c) + shift.

    Rows whose vector is null, or holds null or non-finite entries or such
    whose integer is beyond 2**52, are dropped, and rows whose vector hasn't
    the length that most remaining rows have (the longer one of ties; empty
    vectors have none).  Rows that repeat, null ids included, stay.
    """
    scaled = F.transform(quoted(vec_col).cast("array<double>"), lambda c: F.floor(c * scale))
    fits = F.coalesce(F.forall(quoted(vec_col).cast("array<double>"), lambda c: F.coalesce(
        F.abs(c) * abs(scale) < F.lit(float(LARGEST - abs(shift) - 1)), F.lit(False))), F.lit(False))
    kept = vectors.filter(fits).select(
        quoted(id_col).alias("vec_id"), F.transform(scaled, lambda y: y.cast("long") + shift).alias("x"))
    sizes = kept.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size("x") == (most.d if most else -1))


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``total`` (per dimension) and ``n`` rows,
    ``components`` (d x k, by falling eigenvalue), ``eigenvalues``, and the
    ``trace`` of the covariance."""

    n: int
    total: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _Centre(self.n, self.total)(x)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


class _Centre:
    """Subtracts the mean: the whole part exactly, then the rest."""

    def __init__(self, n: int, total: tuple[int, ...]):
        self.n = n
        self.whole = np.array([t // n for t in total], dtype=np.int64)
        self.over = np.array([t % n for t in total], dtype=np.int64)
        self.rest = self.over / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum of (n * x - total)² over dimensions."""
        off = x - self.whole
        high = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if high * high * max(x.shape[1], 1) < 1 << 63:
            t = off * self.n - self.over
            return (t * t).sum(axis=1).tolist()
        return [sum((a * self.n - b) ** 2 for a, b in zip(row, self.over.tolist())) for row in off.tolist()]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _blocks(x: DataFrame, work: Workspace) -> DataFrame:
    """The vectors as rows of many vectors each, for the passes to come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("x"))
            step = max(1, BLOCK_ENTRIES // rows.shape[1])
            parts = [rows[k:k + step] for k in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())],
                                             names=["rows"])

    return work.stage(x.select("x").mapInArrow(pack, "rows binary"), "rows")


def _summed(blocks: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str, width: int) -> list:
    """The sum over all blocks of ``of(rows)``, ``width`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("rows"):
                part = of(np.frombuffer(block.as_buffer(), dtype="<i8").reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))],
                                             names=["part"])

    parts = blocks.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "value"))
    value = F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value"))
    out = [0] * width
    for r in parts.groupBy("at").agg(value.alias("value")).collect():  # ``width`` rows
        out[r["at"]] = int(r["value"]) if kind == "long" else r["value"]
    return out


def fit(blocks: DataFrame, d: int, components: int = 8, seed: int = 42) -> Whitening | None:
    """Fit on a table of ``rows`` blocks of d-vectors; None if it is empty.

    Directions along which the rows don't differ (eigenvalue 0 to double
    precision) are no components, so there may be fewer than asked for.
    """
    low = (1 << 26) - 1
    sums = _summed(blocks, d, lambda x: np.concatenate(([len(x)], (x >> 26).sum(axis=0), (x & low).sum(axis=0))),
                   "long", 2 * d + 1)
    n = sums[0]
    if not n:
        return None
    total = tuple((a << 26) + b for a, b in zip(sums[1:d + 1], sums[d + 1:]))
    centre = _Centre(n, total)
    energy = _summed(blocks, d, lambda x: np.array([(centre(x) ** 2).sum()]), "double", 1)[0]

    rng = np.random.default_rng(seed)
    tiny = np.finfo(float).eps * max(d, 1)
    right: list[np.ndarray] = []  # the v
    left: list[np.ndarray] = []  # c of each u = Xc
    back: list[np.ndarray] = []  # Xᵀu of each u
    small = np.zeros((d, d))  # Uᵀ X V
    captured, v = 0.0, rng.standard_normal(d)
    while len(right) < d and energy > 0 and energy - captured > tiny * energy:
        v = _orthogonal(v, right)
        if v is None:
            v = _orthogonal(rng.standard_normal(d), right)
        c = np.column_stack([*left, v])

        def products(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            uw = rows @ c
            w = uw[:, -1]
            return np.concatenate((np.pad(w @ uw, (0, d + 1 - uw.shape[1])), w @ rows))

        got = np.array(_summed(blocks, d, products, "double", 2 * d + 1))
        k = len(left)
        along, square, z = got[:k], got[k], got[d + 1:]  # Uᵀw, wᵀw, Xᵀw
        column = len(right)
        right.append(v)
        small[:k, column] = along
        alpha = np.sqrt(max(square - along @ along, 0.0))
        captured += square
        if alpha > tiny * np.sqrt(energy):
            coefficients, xu = v - sum((h * a for h, a in zip(along, left)), np.zeros(d)), z - sum(
                (h * b for h, b in zip(along, back)), np.zeros(d))
            left.append(coefficients / alpha)
            back.append(xu / alpha)
            small[k, column] = alpha
            v = xu / alpha
        else:
            v = np.zeros(d)  # the space is exhausted
    sigma, rotated = np.linalg.svd(small[:len(left), :len(right)])[1:] if left else (np.zeros(0), np.zeros((0, 0)))
    eigenvalues = sigma ** 2 / n
    count = min(components, int((eigenvalues > tiny * eigenvalues.max(initial=0)).sum()))
    basis = (np.column_stack(right) @ rotated[:count].T) if count else np.zeros((d, 0))
    for k in range(count):  # a sign that reruns share
        basis[:, k] *= np.sign(basis[np.abs(basis[:, k]).argmax(), k])
    return Whitening(n, total, basis, eigenvalues[:count], energy / n, len(right))


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray | None:
    """The unit vector of v without its parts along the basis; None if
    nothing is left of it."""
    size = np.linalg.norm(v)
    if size == 0:
        return None
    v = v / size
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    left = np.linalg.norm(v)
    return v / left if left > 1e-10 else None


def identity_error(blocks: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry by amount of the whitened rows' covariance minus the
    identity."""
    k = len(model.eigenvalues)
    mean = np.array(_summed(blocks, d, lambda x: model.whitened(x).sum(axis=0), "double", k)) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x) - mean
        return (z.T @ z).ravel()

    covariance = np.array(_summed(blocks, d, squares, "double", k * k)).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8,
           scale: float = 1024.0, shift: int = 100000) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error, deviation_digits``.

    Vectors become integers first (:func:`integers` says which rows drop
    out); the fit and the result are over all the others, repeated rows and
    null ids included.  ``deviation`` is the exact sum of (n * x - S)² over
    dimensions, S the dimension's sum; where that is beyond a long it is null,
    and ``deviation_digits`` always has it as text.  There are as many
    components as asked for, or as the rows differ along; tied ones are any
    orthonormal basis of their space.  Empty tables and such whose rows are
    all alike give no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = integers(vectors, id_col, vec_col)
    id_type = x.schema["vec_id"].dataType
    schema = (f"vec_id {id_type.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double, deviation_digits string")
    first = x.select(F.size("x")).first()
    blocks = _blocks(x, Workspace(spark, "whitening"))
    d = first[0] if first else 0
    model = fit(blocks, d, components) if first else None
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    error = identity_error(blocks, d, model)
    k, n, explained = len(model.eigenvalues), model.n, model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = _Centre(n, model.total)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("x"))
            z, off = model.whitened(rows), centre.deviations(rows)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(each), n)),
                pa.array([v if v < 1 << 63 else None for v in off], pa.int64()).take(pa.array(each)),
                pa.array(z.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error)),
                pa.array(map(str, off), pa.string()).take(pa.array(each)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                      "deviation_digits"])

    return x.mapInArrow(run, schema)
