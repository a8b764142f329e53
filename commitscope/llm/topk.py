"""Exact top-k search by inner product.

Candidates are numbered by descending length and cut into blocks of bounded
size, so a block's greatest length is known.  Blocks are searched in rounds,
longest vectors first, each round ``GROWTH`` times the blocks before it.  A
query carries its ``k``-th best score so far, ``t``, from round to round:

* Cauchy-Schwarz between blocks: a query is no longer sent to blocks whose
  greatest length is below ``t / |q|``, and a block isn't sent to blocks of
  queries that all have done with it;
* Cauchy-Schwarz inside a block: once ``|q| |x| < t``, no later vector can
  enter;
* partial sums over the leading axes of an SVD rotation of all vectors, plus
  the product of the two residual lengths, bound each remaining score from
  above; only vectors whose bound reaches ``t`` are scored.

Bounds are floating point with slack, scores are exact integers.  As a round
searches no more than ``GROWTH`` times what gave ``t``, it finds about ``k``
times ``GROWTH`` new scores a query, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, quoted, shuffle_width

TILE = 1024
LEVELS = 64
GROWTH = 4
QUERY_BLOCK = 8192
MIN_QUERY_BLOCK = 256
MAX_BLOCK = 1 << 16
MIN_BLOCK = 1 << 11
BATCH = 256
NO_SCORE, NO_ID = -(1 << 63), (1 << 63) - 1


def quantized(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """No null vector, no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, d)


def _gram(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of ``x x^T`` over all vectors: ``d * d`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "s"])

    rows = vectors.select("v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(d * d)
    for r in rows:
        out[r["i"]] = r["s"]
    return out.reshape(d, d)


def rotation(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors of the matrix of all vectors, largest first."""
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Block:
    """Candidates by descending length, with leading parts and residuals."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray, lead: int):
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.x, self.length = ids[order], x[order].astype(np.float64), length[order]
        self.whole, self.largest = x[order], float(np.abs(x).max(initial=0))
        self.part = self.x @ basis[:, :lead]
        self.rest = np.sqrt(np.maximum(self.length ** 2 - (self.part ** 2).sum(axis=1), 0))

    def search(self, q_ids: np.ndarray, q: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray,
               floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query row, id, score)`` of each query's best k, ties to the
        smaller id.  Only what ranks before ``(floor, floor_id)`` is found."""
        exact_float = self.largest * float(np.abs(q).max(initial=0)) * q.shape[1] < 2 ** 52
        lead = self.part.shape[1]
        qf = q.astype(np.float64)
        q_part, q_length = qf @ basis[:, :lead], np.sqrt((qf ** 2).sum(axis=1))
        q_rest = np.sqrt(np.maximum(q_length ** 2 - (q_part ** 2).sum(axis=1), 0))
        worst, worst_id = floor.astype(np.int64), floor_id.astype(np.int64)
        slack = 1e-6 * (1.0 + q_length)
        found = [np.zeros(0, np.int64)] * 3
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            t = np.where(worst == NO_SCORE, -np.inf, worst.astype(np.float64))
            live = np.nonzero(q_length * self.length[a] + slack * (1 + self.length[a]) >= t)[0]
            if not len(live):
                break  # all that follow are no longer
            bound = (q_part[live] @ self.part[a:b].T + np.outer(q_rest[live], self.rest[a:b])
                     + slack[live, None] * (1 + self.length[a]))
            hit = bound >= t[live, None]
            cols = np.nonzero(hit.any(axis=0))[0]
            if not len(cols):
                continue
            if exact_float:
                scores = np.rint(qf[live] @ self.x[a:b][cols].T).astype(np.int64)
            else:
                scores = q[live] @ self.whole[a:b][cols].T
            ids, least = self.ids[a:b][cols][None, :], worst[live, None]
            i, j = np.nonzero(hit[:, cols] & (q_ids[live, None] != ids)
                              & ((scores > least) | ((scores == least) & (ids < worst_id[live, None]))))
            rows = [np.concatenate((old, new)) for old, new in
                    zip(found, (live[i], self.ids[a:b][cols[j]], scores[i, j]))]
            order = np.lexsort((rows[1], -rows[2], rows[0]))
            rows = [r[order] for r in rows]
            first = np.searchsorted(rows[0], rows[0], side="left")
            place = np.arange(len(first)) - first
            last = place == k - 1
            worst[rows[0][last]], worst_id[rows[0][last]] = rows[2][last], rows[1][last]
            found = [r[place < k] for r in rows]
        return tuple(found)


def _numbered(work: Workspace, rows: DataFrame, name: str, order: list[Column], size: int) -> DataFrame:
    """``rows`` with ``block``: ``size`` rows each in this order.  A row's
    place is its place in its range plus the rows of the ranges before; a
    count per range reaches the driver."""
    ranged = work.stage(
        rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), name)
    before, starts = 0, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["count"]
    start = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    return (ranged.join(F.broadcast(start), "_range")  # one row a range
            .withColumn("block", F.floor((F.col("_start") + F.col("_place")) / F.lit(size)).cast("int"))
            .drop("_range", "_start", "_place"))


def _levels(rows: DataFrame, first: int, blocks: int, value: Column) -> list[tuple[int, float]]:
    """``(first block after the level, value)`` of up to ``LEVELS`` runs of
    the ``blocks`` blocks from ``first`` on."""
    level = F.floor((F.col("block") - first) * F.lit(LEVELS) / F.lit(blocks)).alias("level")
    got = rows.groupBy(level).agg(F.max("block").alias("last"), value.alias("value")).orderBy("level").collect()
    return [(r["last"] + 1, r["value"]) for r in got]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 64.0, lead_share: float = 0.25) -> DataFrame:
    """Each query's ``k`` best: ``query_id, rank, vec_id, score``.

    ``queries``: which rows are queries (rows whose condition is null are
    not).  A row is no candidate of queries with its own id.  Vectors that
    are null or hold null or non-finite components, and rows with a null id,
    take no part; shorter vectors count as padded with zeros.  A repeated
    candidate counts each time; a repeated query is answered once, and
    queries with one id and different vectors each.  Components times
    ``scale`` must fit a long.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    vector = quoted(vector_col)
    kept = work.stage(vectors.filter(usable(vector) & quoted(id_col).isNotNull()).select(
        quoted(id_col).cast("long").alias("id"), quantized(vector, scale).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("tie")), "vectors")
    n, d, n_q = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("q")).first()
    if not n or not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(1, d)
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v")))
    kept = kept.withColumn("v", F.when(F.size("v") < d, pad).otherwise(F.col("v")))
    basis = rotation(_gram(kept, d))
    lead = max(1, round(d * lead_share))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = min(MAX_BLOCK, max(MIN_BLOCK, n // (2 * shuffle_width(spark))))
    # Equal lengths are told apart by the row's number, so repeated rows spread over blocks.
    rows = work.stage(_numbered(work, kept.select("id", "v", "tie", length.alias("length")), "ranged",
                                [F.desc("length"), F.asc("tie")], size), "blocks")
    asked = work.stage(kept.filter("q").select("id", "v").distinct().select(
        F.monotonically_increasing_id().alias("qn"), F.col("id").alias("q_id"), F.col("v").alias("q_v"),
        length.alias("q_length"), F.lit(NO_SCORE).alias("low"), F.lit(NO_ID).alias("low_id")), "queries")
    blocks, first, taken, best = -(-n // size), 0, 1, None

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if x.num_rows and y.num_rows:
            own = Block(x["id"].to_numpy(), _matrix(x["v"], d), basis, lead)
            number, ids, low, low_id = (y[c].to_numpy() for c in ("qn", "q_id", "low", "low_id"))
            q = _matrix(y["q_v"], d)
            for a in range(0, len(ids), BATCH):
                part = slice(a, a + BATCH)
                row, found, score = own.search(ids[part], q[part], basis, k, low[part], low_id[part])
                for o, c in zip(out, (number[part][row], ids[part][row], found, score)):
                    o.append(c)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["qn", "query_id", "vec_id", "score"])

    # The length that a vector needs to reach a query's k-th best score.
    need = F.when((F.col("low") > 0) & (F.col("q_length") > 0),
                  F.col("low") / F.col("q_length") * F.lit(1 - 1e-6)).otherwise(0.0)
    while first < blocks:
        some = rows.filter((F.col("block") >= first) & (F.col("block") < first + taken))
        reach = _levels(some, first, min(taken, blocks - first), F.max("length"))
        open_ = asked.withColumn("need", need).filter(F.col("need") <= reach[0][1])
        n_open = open_.count()
        if not n_open:
            break  # all that follow are no longer
        width = max(-(-n_open // QUERY_BLOCK), min(-(-shuffle_width(spark) // taken), -(-n_open // MIN_QUERY_BLOCK)))
        dealt = _numbered(work, open_, f"open-{first}", [F.asc("need"), F.asc("qn")], -(-n_open // width))
        wants = _levels(dealt, 0, width, F.min("need"))
        # Both sides meet where a run of query blocks and a run of blocks do: need at most the greatest length.
        x_end = F.coalesce(*[F.when(F.col("block") < end, F.lit(max([e for e, w in wants if w <= far], default=0)))
                             for end, far in reach])
        q_end = F.coalesce(*[F.when(F.col("block") < end, F.lit(max([e for e, far in reach if least <= far],
                                                                    default=first))) for end, least in wants])
        run = lambda low, end: F.explode(F.when(end > low, F.sequence(F.lit(low), end - 1)))
        left = some.select("id", "v", F.col("block").alias("b"), run(0, x_end).alias("qb"))
        right = dealt.select("qn", "q_id", "q_v", "low", "low_id", F.col("block").alias("q_qb"),
                             run(first, q_end).alias("q_b"))
        found = (left.groupBy("b", "qb").cogroup(right.groupBy("q_b", "q_qb"))
                 .applyInArrow(search, "qn long, query_id long, vec_id long, score long"))
        place = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
        best = work.stage((found if best is None else best.drop("rank").unionByName(found))
                          .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), f"best-{first}")
        first += taken
        taken = (GROWTH - 1) * first
        if first < blocks:
            worst = best.filter(F.col("rank") == k).select("qn", F.col("score").alias("low"),
                                                           F.col("vec_id").alias("low_id"))
            asked = work.stage(asked.select("qn", "q_id", "q_v", "q_length").join(worst, "qn", "left").select(
                "qn", "q_id", "q_v", "q_length", F.coalesce("low", F.lit(NO_SCORE)).alias("low"),
                F.coalesce("low_id", F.lit(NO_ID)).alias("low_id")), f"queries-{first}")
    return best.select("query_id", "rank", "vec_id", "score")
