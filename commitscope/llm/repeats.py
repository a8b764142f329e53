"""Removal of repeated passages with a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``length`` bytes that also starts
anywhere else in the corpus.  The suffixes of a whole corpus fit no task, so
the work is first split into groups that hold all places of a string:

1. Each window of ``length`` bytes is named by the least hash of the
   ``GRAM``-byte strings in it (its minimizer).  Equal windows have equal
   names.  Neighbouring windows of one name form a segment (at most
   ``length - GRAM + 1`` windows).
2. Names are counted.  A name with one segment holds no repeat, unless its
   minimizer occurs in it more than once; segments of
   one name that are equal as a whole (by a 64-bit digest) are repeats as a
   whole.  What is left are segments that share a name with different ones:
   the borders of repeats.  Only their bytes are gathered, by name.
3. ``repeated_windows`` concatenates the segments of many names into one
   text, sorts its suffixes and finds the boundaries between suffixes that
   share fewer than ``length`` bytes, by increasing value: each interval of
   suffixes with a common string is extended backwards through the
   transform, breadth first, until strings are ``length`` long.  Neighbours
   without a boundary are repeats.
4. A name with more than ``CROWD`` different segments would crowd one task.
   Its windows are compared by 128-bit digest in a distributed count.

Every step is an aggregate, a splittable join or a task over a bounded
piece of text.  Texts are shuffled only where ``_maybe`` (a Bloom filter of
bounded size) lets their key pass; it spares work and decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, quoted, shuffle_width

LENGTH = 400
GRAM = 200
CROWD = 512
TEXT = 1 << 19
FILTER_BITS = 1 << 23
# Any odd multiplier and any fixed table of 64-bit values will do.
_STEP = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2 ** 64, ``n`` each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = pow(_STEP, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.where(np.arange(size) > 0, np.uint64(base), np.uint64(1)), dtype=np.uint64)
                      for base in (_STEP, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def segments(data: bytes, length: int = LENGTH,
             gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, name, twin)``: runs of window starts with one
    minimizer, and whether it occurs in them more than once (only then can
    windows of one segment be equal)."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    step, back = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * step)))
        grams = (sums[gram:] - sums[:-gram]) * back[:n - gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    width = length - gram + 1  # grams per window
    rows = -(-len(grams) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(grams)] = grams
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows])
    same = least[1:] == least[:-1]
    # Windows that begin with their minimizer, and are followed by one with
    # another occurrence of it.
    again = np.concatenate(([0], np.cumsum(same & (grams[:windows - 1] == least[:-1]))))
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    ends = np.concatenate((starts[1:], [windows]))
    pieces = -(-(ends - starts) // width)  # long runs are cut
    if pieces.max() > 1:
        which = np.repeat(np.arange(len(starts)), pieces)
        part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[which] + part * width
        ends, starts = np.minimum(first + width, ends[which]), first
    return starts, ends - 1, least[starts].view(np.int64), again[ends - 1] > again[starts]


def _sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` symbols at least, and the
    number of each suffix' group by its first 7 symbols."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):
        key <<= 9
        key[:n - i] |= symbols[i:]
    order = np.argsort(key, kind="stable")

    def ranked(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        s = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        return rank

    rank = ranked(order, key)
    groups = rank
    size = 7
    while size < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, dtype=np.int64)
        second[:n - size] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = ranked(order, key)
        size *= 2
    return order, groups


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, whether the ``length`` bytes from each of its starts
    also start elsewhere in the parts."""
    starts = [max(0, len(p) - length + 1) for p in parts]
    if sum(starts) < 2 or length < 8:
        raise ValueError("needs windows of 8 bytes and more") if length < 8 else None
        return [np.zeros(s, dtype=bool) for s in starts]
    # Symbols: 0 ends the text, 1 a part; bytes from 2.
    sizes = np.array([len(p) for p in parts])
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.ones(int(at[-1]) + 1, dtype=np.int64)
    symbols[-1] = 0
    body = np.ones(len(symbols), dtype=bool)
    body[at[1:] - 1] = False
    body[-1] = False
    symbols[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 2
    n = len(symbols)
    order, groups = _sorted_suffixes(symbols, length)
    transform = symbols[order - 1]  # the symbol before each suffix
    last_to_first = np.empty(n, dtype=np.int64)
    last_to_first[np.argsort(transform, kind="stable")] = np.arange(n)
    front = symbols[order]
    # Boundary before row i: the suffixes i - 1 and i differ within the
    # current string length.  Strings of 7 symbols give the first intervals.
    group = groups[order]
    boundary = np.concatenate(([True], group[1:] != group[:-1], [True]))
    lows = np.flatnonzero(boundary[:-1])
    highs = np.concatenate((lows[1:], [n])) - 1
    for _ in range(8, length + 1):
        # A lone suffix stays alone when extended, and cuts nothing new.
        if not len(lows):
            break
        spans = highs - lows + 1
        rows = np.repeat(lows - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        owner = np.repeat(np.arange(len(lows)), spans)
        to = last_to_first[rows]
        by = np.argsort(to, kind="stable")
        to, owner = to[by], owner[by]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (front[to[1:]] != front[to[:-1]])))
        first = np.flatnonzero(new)
        lo, hi = to[first], to[np.concatenate((first[1:], [len(to)])) - 1]
        cuts = ~boundary[hi + 1]
        lows, highs = lo[cuts], hi[cuts]
        boundary[highs + 1] = True
    shared = np.zeros(n, dtype=bool)
    joint = ~boundary[1:-1]
    shared[order[1:][joint]] = True
    shared[order[:-1][joint]] = True
    return [shared[a:a + s] for a, s in zip(at[:-1].tolist(), starts)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[first, end)`` of the runs of true flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _data(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


_SEGMENTS = "k1 long, k2 long, n long, bytes long, first array<int>, last array<int>, name array<long>, d array<long>, twin array<boolean>"


def _segment_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            copies: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(k1, k2)):
                copies.setdefault(key, []).append(i)
            rows = []
            for key, where in copies.items():
                data = _data(batch.column("text")[where[0]])
                first, last, name, twin = segments(data, length, gram)
                if len(first):
                    digests = np.fromiter(
                        (xxhash.xxh3_64_intdigest(data[a:b + length]) for a, b in zip(first.tolist(), last.tolist())),
                        dtype=np.uint64, count=len(first)).view(np.int64)
                    rows.append((*key, len(where), len(data), first, last, name, digests, twin))
            if rows:
                columns = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2 + [
                    pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["k1", "k2", "n", "bytes", "first", "last", "name", "d", "twin"])

    return run


def _cut_batches(length: int):
    """Texts with the segments wanted of them -> the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", "text", "wanted"))):
                data = _data(text)
                for w in wanted.as_py():
                    part = data[w["first"]:w["last"] + length]
                    out.append((w["name"], w["crowd"], w["known"], k1.as_py(), k2.as_py(), w["first"], part))
                    size += len(part)
                    if size > 1 << 23:
                        yield _parts(out)
                        out, size = [], 0
            if out:
                yield _parts(out)

    return run


_PART_TYPES = [("name", pa.int64()), ("crowd", pa.bool_()), ("known", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()),
               ("first", pa.int32()), ("part", pa.binary())]
_PARTS = "name long, crowd boolean, known boolean, k1 long, k2 long, first int, part binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PART_TYPES)],
                                      names=[name for name, _ in _PART_TYPES])


def _compare_batches(length: int):
    """Segments in order of name -> spans; texts of about ``TEXT`` bytes,
    names kept whole."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for (_, known, k1, k2, first, _part), flags in zip(rows, repeated_windows([r[5] for r in rows], length)):
            if not known:
                a, b = _runs(flags)
                for o, c in zip(out, (np.full(len(a), k1), np.full(len(a), k2), first + a, first + b - 1 + length)):
                    o.append(c)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(o) if o else np.zeros(0), t) for o, t in
             zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, previous = 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("name", "known", "k1", "k2", "first", "part")]
            for row in zip(*columns):
                if size > TEXT and row[0] != previous:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
                previous = row[0]
        if rows:
            yield spans(rows)

    return run


def _digest_batches(length: int):
    """Segments of crowded names -> a 128-bit digest per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, k1, k2, first, part in zip(*(batch.column(c).to_pylist() for c in
                                                    ("known", "k1", "k2", "first", "part"))):
                n = len(part) - length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(part[i:i + length]) for i in range(n)),
                                  dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)),
                     pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(np.full(n, known)),
                     pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))],
                    names=["k1", "k2", "a", "known", "d1", "d2"])

    return run


SALTS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(7), text).alias("k2"))


def _maybe(keys: DataFrame, bits: int = FILTER_BITS):
    """A Bloom filter of ``keys.k1`` as a pandas UDF on ``k1``: never false
    for one of the keys.  ``bits / 64`` words reach the driver."""
    places = F.explode(F.array(F.col("k1").bitwiseAND(bits - 1), F.shiftrightunsigned("k1", 32).bitwiseAND(bits - 1)))
    words = np.zeros(bits // 64, dtype=np.uint64)
    for r in (keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
              .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("b")).collect()):
        words[r["w"]] = np.int64(r["b"]).view(np.uint64)

    @F.pandas_udf("boolean")
    def maybe(k1: pd.Series) -> pd.Series:
        v = k1.to_numpy().view(np.uint64)
        out = np.ones(len(v), dtype=bool)
        for p in (v & np.uint64(bits - 1), (v >> np.uint64(32)) & np.uint64(bits - 1)):
            out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return maybe


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, crowd: int = CROWD, work: Workspace | None = None) -> DataFrame:
    """``(k1, k2, bytes, runs)``: for each text (by two hashes) with repeats,
    its size and the maximal byte ranges ``{a, b}`` that they cover."""
    work = work or Workspace(docs.sparkSession, "repeats")
    texts = _keyed(docs, id_col, text_col).filter(F.octet_length("text") >= length).select("k1", "k2", "text")
    rows = work.stage(texts.mapInArrow(_segment_batches(length, gram), _SEGMENTS), "segments")
    each = rows.select("k1", "k2", "n", "bytes", F.explode(F.arrays_zip("first", "last", "name", "d", "twin")).alias("s"))
    each = each.select("k1", "k2", "n", "bytes", "s.*")
    names = work.stage(each.groupBy("name").agg(F.sum(F.col("n") + F.col("twin").cast("int")).alias("m"))
                       .filter("m > 1").select("name"), "names")
    shared = work.stage(each.join(names, "name"), "shared")
    place = F.struct("k1", "k2", "first", "last")
    counted = work.stage(shared.groupBy("name", "d").agg(F.sum("n").alias("m"), F.max("twin").alias("twin"),
                                                         F.min(place).alias("p")), "counted")
    kinds = work.stage(counted.groupBy("name").agg(F.count("*").alias("kinds"), F.max("twin").alias("twin"))
                       .filter("kinds > 1 or twin").select("name", "kinds"), "kinds")
    # Of each name with different segments, or with equal windows in one:
    # those that occur once, and one place of each that occurs more often.
    borders = counted.join(kinds, "name").select("name", "p.*", (F.col("m") > 1).alias("known"),
                                                 (F.col("kinds") > crowd).alias("crowd"))
    wanted = work.stage(borders.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("first", "last", "name", "known", "crowd")).alias("wanted")), "wanted")
    # A text that stands for its copies may be cut once for each of them.
    cut = (texts.filter(_maybe(wanted)("k1")).join(wanted, ["k1", "k2"])
           .mapInArrow(_cut_batches(length), _PARTS))
    parts = work.stage(cut, "parts").dropDuplicates(["name", "k1", "k2", "first"])
    width = shuffle_width(docs.sparkSession)
    compared = (parts.filter("not crowd").repartition(width, "name").sortWithinPartitions("name")
                .mapInArrow(_compare_batches(length), "k1 long, k2 long, a int, b int"))
    digests = work.stage(parts.filter("crowd").mapInArrow(
        _digest_batches(length), "k1 long, k2 long, a int, known boolean, d1 long, d2 long"), "digests")
    twice = work.stage(digests.groupBy("d1", "d2").agg(F.count("*").alias("m")).filter("m > 1").select("d1", "d2"),
                       "twice")
    crowded = digests.filter("not known").join(twice, ["d1", "d2"]).select(
        "k1", "k2", "a", (F.col("a") + length).alias("b"))
    single = counted.filter("m = 1").select("name", "d")
    whole = shared.join(single, ["name", "d"], "left_anti").select(
        "k1", "k2", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    sizes = shared.groupBy("k1", "k2").agg(F.max("bytes").alias("bytes"))
    spans = (whole.unionByName(compared).unionByName(crowded)
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_merged([(x["a"], x["b"]) for x in spans]) for spans in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"),
                 pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], _RUNS)], names=["k1", "k2", "runs"])

    merged = work.stage(spans.mapInArrow(merge, "k1 long, k2 long, runs array<struct<a:int,b:int>>"), "runs")
    return work.stage(merged.join(sizes, ["k1", "k2"]), "spans")


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [tuple(r) for r in runs]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, removed`` (the maximal removed byte ranges), ``n_kept`` and
    ``kept_text``, what is left (a character that a range cuts through shows
    as U+FFFD there; the digest is of the bytes).

    Null texts count as empty.  A row that repeats is a repeat of itself, so
    texts of ``length`` bytes and more that occur twice go whole.  An empty
    table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, id_col, text_col, length, gram, crowd, work)
    maybe = _maybe(spans)
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    # Texts without repeats pass as they are.  The others meet their ranges;
    # copies of one text are dealt over several keys.
    none = F.array().cast("array<struct<a:int,b:int>>")
    clean = keyed.filter(~maybe("k1")).select("doc_id", "text", F.sha2("text", 256).alias("kept_sha256"), none.alias("removed"),
                                              F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = keyed.filter(maybe("k1")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(
        spans.select("k1", "k2", "runs", salt.alias("salt")), ["k1", "k2", "salt"], "left").select(
        "doc_id", "text", F.coalesce("runs", none).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests, sizes, removed = [], [], [], []
            for t, runs in zip(batch.column("text"), batch.column("removed").to_pylist()):
                data = _data(t)
                kept = without(data, [(r["a"], r["b"]) for r in runs])
                texts.append(bytes(kept).decode("utf-8", "replace"))
                digests.append(hashlib.sha256(kept).hexdigest())
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(digests, pa.string()),
                 batch.column("removed"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())],
                names=["doc_id", "text", "kept_sha256", "removed", "n_bytes", "n_removed"])

    cut = found.mapInArrow(run, f"doc_id {id_type}, text string, kept_sha256 string, removed array<struct<a:int,b:int>>, "
                                "n_bytes long, n_removed long")
    return clean.unionByName(cut).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "removed",
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.col("text").alias("kept_text"))
