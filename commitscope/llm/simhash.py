"""SimHash near-dedup by tiled exact comparison.

Fingerprints: ``fingerprints`` (Arrow batches, XXH64 of word shingles).
Links: distinct fingerprints are laid into tiles by their population counts
(of ``m`` equal parts of the 64 bits).  Bits that differ change a part's
count by one each, so two tiles whose counts differ by more than the radius
in sum hold no link and are never paired.  The remaining tile pairs are
compared in full with exclusive-or and ``bitwise_count``.  A tile holds a
bounded number of fingerprints: a class of counts with more is cut into
several tiles by a hash, and all pairs of those tiles are compared.

A tile pair returns a spanning star of each connected set it finds, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, one_row_each, quoted
from .components import connected_components

SEED = 42
TILE = 2048
# Share of random 64-bit fingerprints that have the commonest counts, by the
# number of parts: collision probability of a binomial, to the power m.
_SHARE = {1: 0.0993, 2: 0.0196, 4: 3.9e-4, 8: 2.2e-6, 16: 1e-9}


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
        n = len(words) - shingle + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    set_in = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 14):
        block = np.fromiter(islice(hashes, 1 << 14), dtype="<u8", count=min(1 << 14, n - start))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, k, fp)``: ``k`` a hash of the text, ``fp`` as a signed long
    with the fingerprint's bits."""
    source = docs.select(quoted(id_col).alias("id"), _text_key(text_col).alias("k"),
                         quoted(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), dtype=np.uint64,
                             count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(fp.view(np.int64))],
                                              names=["id", "k", "fp"])

    return source.mapInArrow(sign, f"id {source.schema['id'].dataType.simpleString()}, k long, fp long")


def _parts_for(n: int) -> int:
    return next((m for m, share in _SHARE.items() if n * share <= TILE), 16)


def _counts(fp: Column, parts: int) -> Column:
    """The parts' population counts as one number, a digit of base 128 each
    part for up to 8 parts, base 8 for 16."""
    width = 64 // parts
    base = 8 if parts == 16 else 128
    mask = (1 << width) - 1
    total = F.lit(0).cast("long")
    for i in range(parts):
        part = F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask if width < 64 else -1).cast("long"))
        total = total + F.bit_count(part).cast("long") * F.lit(base ** i).cast("long")
    return total


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of ``_counts`` numbers within the radius, one of each
    pair of opposite ones, and none."""
    base = 8 if parts == 16 else 128
    steps = {(0,) * parts}
    for _ in range(radius):
        steps |= {s[:i] + (s[i] + d,) + s[i + 1:] for s, i, d in product(steps, range(parts), (-1, 1))}
    near = {s for s in steps if sum(map(abs, s)) <= radius}
    return sorted(sum(d * base ** i for i, d in enumerate(s)) for s in near if s >= (0,) * parts)


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of two tiles of unsigned fingerprints (one tile with itself, if
    they are the same object), reduced to ``(node, root)`` stars."""
    both = left if left is right else np.concatenate((left, right))
    root = np.arange(len(both))
    offset = 0 if left is right else len(left)
    rows = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at:at + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + offset
        i, j = i[i != j], j[i != j]
        while len(i):  # hook the larger root to the smaller, then shorten all paths
            a, b = root[i], root[j]
            if not (a != b).any():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    moved = np.nonzero(root != np.arange(len(root)))[0]
    return both[moved], both[root[moved]]


def _compare_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for same, x, y in zip(batch.column("same").to_pylist(), batch.column("x"), batch.column("y")):
                left = x.values.to_numpy().view(np.uint64)
                parts.append(compare(left, left if same else y.values.to_numpy().view(np.uint64), radius))
            if parts:
                a, b = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, work: Workspace, radius: int, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """``fps(fp)`` distinct -> ``(a, b)``: links that span the same
    connected sets as all pairs within ``radius`` bits."""
    parts = parts or _parts_for(fps.count())
    counted = fps.select("fp", _counts(F.col("fp"), parts).alias("c"))
    sizes = work.stage(counted.groupBy("c").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "sizes")
    laid = (counted.join(sizes, "c")
            .groupBy("c", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("t"))
            .agg(F.collect_list("fp").alias("fps")))  # about ``tile`` of them
    tiles = work.stage(laid, "tiles")
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(parts, radius)]))
    pairs = (sizes.select("c", F.col("tiles").alias("n"), steps.alias("step"))
             .withColumn("c2", F.col("c") + F.col("step"))
             .join(sizes.select(F.col("c").alias("c2"), F.col("tiles").alias("n2")), "c2")
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
             .filter("c != c2 or t <= t2").select("c", "t", "c2", "t2"))
    same = (F.col("c") == F.col("c2")) & (F.col("t") == F.col("t2"))
    grid = (pairs.join(tiles.select("c", "t", F.col("fps").alias("x")), ["c", "t"])
            .join(tiles.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("fps").alias("y")), ["c2", "t2"])
            .select(same.alias("same"), "x", F.when(same, F.array().cast("array<long>")).otherwise(F.col("y")).alias("y")))
    return grid.mapInArrow(_compare_batches(radius), "a long, b long")


def _classify(docs: DataFrame, id_col: str, text_col: str, shingle: int,
              radius: int) -> tuple[Workspace, DataFrame, DataFrame]:
    """Staged ``(id, k, fp)`` per row, ``k`` a hash of the text, and
    ``(fp, root, component_id)`` per distinct fingerprint."""
    work = Workspace(docs.sparkSession, "simhash")
    signed = work.stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    known = work.stage(signed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = work.stage(connected_components(links(known.select("fp"), work, radius), work), "roots")
    rooted = work.stage(known.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = work.stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return work, signed, work.stage(rooted.select("fp", "root").join(least, "root"), "classes")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Null and empty texts have fingerprint zero, which links like any other.
    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits (null only if the whole component has null
    ids).  Repeated rows give repeated results; an empty table gives none;
    other columns are ignored.
    """
    _, signed, named = _classify(docs, id_col, text_col, shingle, radius)
    return signed.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
              radius: int = 2) -> DataFrame:
    """``docs`` with one row left of each component: of the rows with its
    smallest id, one with the least fingerprint and text hash (all columns
    as they were; null ids count only where a component has no other)."""
    work, signed, named = _classify(docs, id_col, text_col, shingle, radius)
    head = F.min(F.struct("fp", "k", "n")).alias("m")
    heads = work.stage(
        signed.join(named, "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "id", "fp", "k").agg(F.count("*").alias("n"))
        .groupBy("root", "id").agg(head).select("id", F.col("m.k").alias("k"), F.col("m.n").alias("n")), "heads")
    names = {c: fresh(f"_{c}", docs.columns) for c in ("id", "k", "n")}
    rows = docs.withColumn(names["k"], _text_key(text_col))
    kept = rows.join(heads.select(*[F.col(c).alias(v) for c, v in names.items()]), names["k"]).filter(
        quoted(id_col).eqNullSafe(F.col(names["id"])))
    kept = one_row_each(kept, [names["id"], names["k"]], F.col(names["n"]) > 1, not heads.filter("n > 1").isEmpty())
    return kept.select(*[quoted(c) for c in docs.columns])
