"""Quality classifier: histogram gradient-boosted trees over document
statistics.

``statistics`` turns whole texts into a row of numbers (Arrow batches).
``fit_trees`` grows trees on binned columns by gradient histograms and lays
them into flat arrays (a complete binary tree each); ``score_rows`` walks all
trees of all rows at once with numpy indexing.  Training reads at most
``max_train`` labelled rows, those with the smallest hash of their id;
scoring reads everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import quoted

MAX_TRAIN = 20_000
BINS = 64
STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "distinct_words", "log_distinct_share", "top_word",
    "repeated_neighbours", "upper", "digit", "space", "punctuation", "pipes", "marks", "stops", "commas", "non_ascii",
    "control", "byte_entropy", "short_words", "long_words", "log_lines", "distinct_lines", "chars_per_line",
    "words_with_digit", "title_words")

_UPPER, _LOWER, _DIGIT = (np.arange(a, b) for a, b in ((65, 91), (97, 123), (48, 58)))
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; null counts as empty, whose ratios are 0."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    counts = Counter(words)
    lines = text.split("\n")
    share = histogram[histogram > 0] / n
    of = lambda codes: float(histogram[codes].sum()) / n
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))),
        float(sizes.mean()) if words else 0.0, float(sizes.std()) if words else 0.0,
        len(counts) / w, float(np.log1p(len(counts)) / np.log1p(w)),
        max(counts.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w,
        of(_UPPER), of(_DIGIT), of(_SPACE), of(_PUNCT),
        of([ord("|")]), of([ord("!"), ord("?"), ord("#"), ord("*")]), of([ord(".")]), of([ord(",")]),
        float(histogram[128:].sum()) / n, float(histogram[:9].sum() + histogram[14:32].sum()) / n,
        float(-(share * np.log2(share)).sum()),
        float((sizes <= 3).mean()) if words else 0.0, float((sizes >= 15).mean()) if words else 0.0,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))),
        sum(c for x, c in counts.items() if not x.isalpha() and any(map(str.isdigit, x))) / w,
        sum(c for x, c in counts.items() if x.istitle()) / w]


@dataclass
class Trees:
    """``feature[t, node]`` and ``cut[t, node]`` of inner nodes (children of
    ``i``: ``2i + 1`` where the value is at most the cut, ``2i + 2``), and
    ``leaf[t, k]``, all of one depth."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1,
              min_leaf: float = 1.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over binned columns.  One class
    only, or no rows, gives a constant score (0.5 without rows)."""
    n, k = x.shape
    nodes = (1 << depth) - 1
    empty = Trees(0.0, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    if not n:
        return empty
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    empty.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    model = Trees(empty.base, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                  np.zeros((trees, nodes + 1)))
    raw = np.full(n, model.base)
    for t in range(trees):
        p = _sigmoid(raw)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, dtype=np.int64)  # node within the level
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            which, where = np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            for f in range(k):
                cell = at * BINS + binned[f]
                g = np.bincount(cell, weights=grad, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, weights=hess, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g * g / (h + ridge) + gr * gr / (hr + ridge) - (g[:, -1:] ** 2) / (h[:, -1:] + ridge)
                gain = np.where((h >= min_leaf) & (hr >= min_leaf), gain, 0.0)
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best
                best, which, where = np.where(better, top, best), np.where(better, f, which), np.where(better, b, where)
            first = width - 1
            for j in range(width):
                model.feature[t, first + j] = which[j]
                c = cuts[which[j]]
                model.cut[t, first + j] = c[where[j]] if where[j] < len(c) else np.inf
            at = 2 * at + (binned[which[at], np.arange(n)] > where[at])
        size = 1 << depth
        value = np.bincount(at, weights=grad, minlength=size) / (np.bincount(at, weights=hess, minlength=size) + ridge)
        model.leaf[t] = rate * value
        raw = raw + model.leaf[t][at]
    return model


def score_rows(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row."""
    raw = np.full(len(x), model.base)
    if len(model.leaf):
        tree = np.arange(len(model.leaf))[None, :]
        for start in range(0, len(x), 4096):
            rows = x[start:start + 4096]
            node = np.zeros((len(rows), len(model.leaf)), dtype=np.int64)
            row = np.arange(len(rows))[:, None]
            for _ in range(model.depth):
                node = 2 * node + 1 + (rows[row, model.feature[tree, node]] > model.cut[tree, node])
            raw[start:start + 4096] += model.leaf[tree, node - (model.leaf.shape[1] - 1)].sum(axis=1)
    return _sigmoid(raw)


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


def held_out(id_col) -> F.Column:
    """Rows that labels are never learned from (a null id is held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees from at most ``max_train`` labelled ids that aren't held out.

    Rows with a null id or label don't count; an id labelled more than once
    counts as 1 if any label is 1; of several texts of one id one counts.
    """
    ship_package(docs.sparkSession)
    sample = (labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y"))
              .filter("id is not null and y is not null").filter(~held_out(F.col("id")))
              .groupBy("id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    # At most ``max_train`` short rows: safe to send to every executor.
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    id_type = texts.schema["id"].dataType.simpleString()
    rows = (texts.mapInArrow(run, f"id {id_type}, y int, x array<double>")
            .groupBy("id").agg(F.max("y").alias("y"), F.max("x").alias("x")).orderBy("id").toPandas())
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit_trees(x, rows["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted`` (1 from
    ``threshold`` up).  Null and empty texts are scored by the statistics of
    an empty text; an empty table gives no rows; other columns are ignored."""
    ship_package(docs.sparkSession)
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_rows(model, _matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that ``score`` predicts 1 for, all columns as they were."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array(score_rows(model, _matrix(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
