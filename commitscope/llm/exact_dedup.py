"""Exact dedup through an extendible-hash index on shared files.

1. The 64-bit hashes of all texts are counted by their leading bits (an
   aggregate; at most ``2 ** MAX_DEPTH`` counters reach the driver).
2. ``Directory`` starts with a single bucket and splits every bucket with
   more than ``capacity`` distinct hashes by one more bit, doubling its slots
   whenever a bucket as deep as the directory splits.  Buckets are ranges of
   the hash, numbered in key order; an owner is a run of neighbouring buckets
   of about equal weight.
3. Every input batch first combines its own copies (one entry per distinct
   text and batch), so that a text which fills a third of the input reaches
   its owner as a few entries.
4. Each owner task walks its key range in hash order, keeps the chain of
   distinct texts of the current hash and compares bytes, and writes its
   bucket pages to the shared folder.
5. Rows look their class up in those pages.

A bucket at the greatest depth may hold more than ``capacity`` hashes; it
only makes an owner's range longer, as an owner holds one hash's chain at a
time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, one_row_each, quoted, shuffle_width

MAX_DEPTH = 16
CAPACITY = 256
OWNERS_PER_PARTITION = 8


class Directory:
    """Extendible-hash directory over the leading bits of 64-bit hashes."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """``counts``: distinct hashes by leading bits, ``2 ** k`` of them."""
        limit = int(np.log2(len(counts)))
        before = np.concatenate(([0], np.cumsum(counts)))
        self.depth = 0
        slots = [0]
        buckets = [(0, 0)]  # (prefix, local depth)

        def weight(bucket: tuple[int, int]) -> int:
            prefix, local = bucket
            width = 1 << (limit - local)
            return int(before[(prefix + 1) * width] - before[prefix * width])

        work = [0]
        while work:
            b = work.pop()
            prefix, local = buckets[b]
            if weight(buckets[b]) <= capacity or local == limit:
                continue
            if local == self.depth:  # double the directory
                slots = [s for s in slots for _ in (0, 1)]
                self.depth += 1
            buckets[b] = (2 * prefix, local + 1)
            buckets.append((2 * prefix + 1, local + 1))
            span = 1 << (self.depth - local - 1)
            first = (2 * prefix + 1) * span
            slots[first:first + span] = [len(buckets) - 1] * span
            work += [b, len(buckets) - 1]
        order = sorted(range(len(buckets)), key=lambda i: buckets[i][0] << (limit - buckets[i][1]))
        rank = {b: i for i, b in enumerate(order)}
        self.slots = np.array([rank[s] for s in slots], dtype=np.int32)
        self.local_depths = [buckets[b][1] for b in order]
        self.weights = np.array([weight(buckets[b]) for b in order], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.local_depths)

    def owners(self, wanted: int) -> np.ndarray:
        """Owner of each bucket: runs of neighbours of about equal weight."""
        share = max(1.0, (self.weights.sum() + len(self)) / max(1, wanted))
        middle = np.cumsum(self.weights + 1) - (self.weights + 1) / 2
        return np.unique((middle / share).astype(np.int64), return_inverse=True)[1].astype(np.int32)

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        if self.depth == 0:
            return np.zeros(len(hashes), dtype=np.int32)
        return self.slots[(hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _directory(keyed: DataFrame, capacity: int) -> Directory:
    top = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    counts = np.zeros(1 << MAX_DEPTH, dtype=np.int64)
    for r in keyed.select("h").distinct().groupBy(top.alias("slot")).count().collect():  # at most 2 ** MAX_DEPTH
        counts[r["slot"]] = r["count"]
    return Directory(counts, capacity)


def _combiner(directory: Directory, owners: np.ndarray):
    """Per Arrow batch: one entry per distinct text."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, coded = batch.column("id"), batch.column("text").dictionary_encode()
            grouped = pa.table({"c": coded.indices, "id": ids}).group_by("c").aggregate(
                [("id", "max"), ("id", "count")]).sort_by("c")
            code = coded.indices.to_numpy()
            best = grouped["id_max"].combine_chunks()
            best = best.combine_chunks() if isinstance(best, pa.ChunkedArray) else best
            same = pc.fill_null(pc.equal(ids, best.take(coded.indices)), False).to_numpy(zero_copy_only=False)
            n = np.bincount(code, minlength=len(coded.dictionary))
            top = np.bincount(code, weights=same, minlength=len(n)).astype(np.int64)
            top = np.where(best.is_null().to_numpy(zero_copy_only=False), n, top)
            first = np.unique(code, return_index=True)[1]
            h = batch.column("h").to_numpy()[first]
            bucket = directory.bucket_of(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners[bucket]), pa.array(bucket), pa.array(h), coded.dictionary, best,
                 pa.array(n.astype(np.int64)), pa.array(top)],
                names=["owner", "bucket", "h", "text", "keep_id", "n", "n_top"])

    return combine


def _own(id_type: pa.DataType):
    """Entries in hash order -> one row per distinct text, bytes compared
    along the chain of each hash."""

    def merged(chain: list) -> list:
        out: list = []
        for b, h, text, keep, n, top in chain:
            for known in out:
                if known[2] == text:
                    if keep == known[3]:
                        known[5] += top
                    elif known[3] is None or (keep is not None and keep > known[3]):
                        known[3], known[5] = keep, top
                    known[4] += n
                    break
            else:
                out.append([b, h, text, keep, n, top])
        return out

    def batch_of(rows: list) -> pa.RecordBatch:
        b, h, text, keep, n, top = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int32()), pa.array(h, pa.int64()), pa.array(text, pa.string()),
             pa.array(keep, id_type), pa.array(n, pa.int64()), pa.array(top, pa.int64())],
            names=["bucket", "h", "text", "keep_id", "n", "n_top"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list = []
        done: list = []
        size = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "h", "text", "keep_id", "n", "n_top")]
            for row in zip(*cols):
                if chain and chain[0][1] != row[1]:
                    done += chain if len(chain) == 1 else merged(chain)
                    size += len(chain[0][2])
                    chain = []
                    if size > 1 << 24 or len(done) > 10_000:
                        yield batch_of(done)
                        done, size = [], 0
                chain.append(list(row))
                if len(chain) > 64:  # copies of a hot text collapse as they come
                    chain = merged(chain)
        done += merged(chain)
        if done:
            yield batch_of(done)

    return own


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """The index pages: one row per distinct text with ``bucket``, ``h``,
    ``sha`` (SHA-256, lower-case hex), ``keep_id`` (largest id, nulls below
    all), ``n`` (rows) and ``n_top`` (rows that carry ``keep_id``)."""
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    keyed = _keyed(docs, id_col, text_col)
    directory = _directory(keyed, capacity)
    width = shuffle_width(spark)
    owners = directory.owners(width * OWNERS_PER_PARTITION)
    id_type = keyed.schema["id"].dataType.simpleString()
    entry = f"bucket int, h long, text string, keep_id {id_type}, n long, n_top long"
    entries = keyed.mapInArrow(_combiner(directory, owners), f"owner int, {entry}")
    owned = (entries.repartition(width, "owner").sortWithinPartitions("bucket", "h").drop("owner")
             .mapInArrow(_own(to_arrow_type(keyed.schema["id"].dataType)), entry))
    return work.stage(owned.select("bucket", "h", F.sha2("text", 256).alias("sha"), "keep_id", "n", "n_top"),
                      "pages")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    Null texts equal empty ones.  The row with the largest id stays (a null
    id is below all others); of several rows with the same text and that id
    exactly one is ``kept``.  An empty table gives no rows; other columns
    are ignored.
    """
    pages = build_index(docs, id_col, text_col, capacity)
    rows = (_keyed(docs, id_col, text_col).select("id", "h", F.sha2("text", 256).alias("sha"))
            .join(pages.drop("bucket"), ["h", "sha"]))
    is_top = F.col("id").eqNullSafe(F.col("keep_id"))
    tied = is_top & (F.col("n_top") > 1)
    if pages.filter("n_top > 1").isEmpty():
        flagged = rows.withColumn("kept", is_top)
    else:
        # Rows with equal id and text differ in nothing that is returned:
        # count them, then write one kept row and the others.
        counted = (rows.filter(tied).groupBy("id", "h", "sha", "keep_id", "n", "n_top").count()
                   .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
                   .withColumn("kept", F.col("i") == 1).drop("count", "i"))
        flagged = rows.filter(~tied).withColumn("kept", is_top).unionByName(counted)
    return flagged.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept",
                          F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with the one row of every text that ``classes`` keeps, all
    columns as they were."""
    from .common import fresh

    pages = build_index(docs, id_col, text_col, capacity)
    names = {k: fresh(f"_{k}", docs.columns) for k in ("h", "sha", "keep_id", "n_top")}
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({names["h"]: F.xxhash64(text), names["sha"]: F.sha2(text, 256)})
    top = pages.select(*[F.col(k).alias(v) for k, v in names.items()])
    kept = rows.join(top, [names["h"], names["sha"]]).filter(quoted(id_col).eqNullSafe(F.col(names["keep_id"])))
    kept = one_row_each(kept, [names["h"], names["sha"]], F.col(names["n_top"]) > 1,
                        not pages.filter("n_top > 1").isEmpty())
    return kept.select(*[quoted(c) for c in docs.columns])
