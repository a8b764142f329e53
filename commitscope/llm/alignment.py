"""Cross-tokenizer alignment.

Each text is encoded by two tokenizers whose tokens spell the same bytes.
Byte offsets at which a token of both ends cut the tokens into groups; all
tokens of a group are linked.

Most tokens of two vocabularies stand one to one, so the end offsets of both
are equal at a constant difference of their indices (a diagonal).
:func:`shared_runs` jumps such stretches by exponential probing: it compares
slices of doubling length on the current diagonal, and halves back to the
first difference.  From there the irregular group is walked token by token
until both ends meet again, on a new diagonal.

Counts of linked id pairs are over the whole corpus.  Tasks deal their
documents into blocks of a bounded number of links; a block sends each of its
distinct pairs once, with the number of its documents that hold it, and gets
back the corpus counts of just these pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Workspace, quoted
from .pieces import Pieces, ranges

SLICE_CHARS = 1 << 20
ENDLESS = 4096
EXPANDED = 256  # groups of more links are counted by their distinct ids
BLOCK_LINKS = 1 << 21
# Fixed value: how byte-level BPE of this kind cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: its
    Latin-1 character where that is printable, else the next free one from
    U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers
    library.  Special tokens are plain text."""

    def __init__(self, data: bytes):
        self.data = data
        spec = json.loads(data)
        letters = byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.spelled: dict[int, bytes] = {}
        for entry, i in spec["model"]["vocab"].items():
            if entry not in special:
                self.spelled[i] = bytes(letters[c] for c in entry)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        cut = spec.get("pre_tokenizer") or {}
        # Ids are ranks where merges make them in order; then the quicker
        # library gives the same ids.
        self.ranked = (made == sorted(made) and spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
                       and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                       and len({b for b in self.spelled.values() if len(b) == 1}) == 256)
        self.size = max(spec["model"]["vocab"].values()) + 1

    @cached_property
    def sizes(self) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        for i, b in self.spelled.items():
            out[i] = len(b)
        return out

    @cached_property
    def _quick(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.spelled.items()},
                                 special_tokens={})

    @cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.data.decode("utf-8"))
        out.encode_special_tokens = True
        return out

    def encode(self, text: str) -> np.ndarray:
        # The quicker library takes quadratic time on endless words.
        if self.ranked and (len(text) < ENDLESS or not _ENDLESS(text)):
            return self._quick.encode_to_numpy(text)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(self.spelled.get(i, b"") for i in ids.tolist())


_ENDLESS = re.compile(rf"\S{{{ENDLESS}}}|\s{{{ENDLESS}}}").search


def shared_runs(a: list[int], b: list[int]) -> np.ndarray:
    """Rows ``i, j, n`` with ``a[i + k] == b[j + k]`` for all k < n: all pairs
    of equal values in two rising lists of positive numbers that end in the
    same one."""
    found: list[int] = []
    size = len(a)
    a, b = [*a, -1], [*b, -2]  # never equal, so no stretch runs past an end
    i = j = 0
    while i < size:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: to where both meet
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        p, q = i + 1, j + 1
        if a[p] == b[q]:
            p, q, step = p + 1, q + 1, 2
            while a[p:p + step] == b[q:q + step]:
                p += step
                q += step
                step *= 2
            while step > 1:
                step //= 2
                if a[p:p + step] == b[q:q + step]:
                    p += step
                    q += step
        found += i, j, p - i
        i, j = p, q
    return np.array(found, dtype=np.int64).reshape(-1, 3)


class Aligned:
    """The alignment of some texts, token by token and text by text."""

    def __init__(self, texts: list[str | None], one: ByteTokens, two: Pieces):
        n = len(texts)
        nothing = np.zeros(0, dtype=np.uint32)
        ids_a = [one.encode(" " + t) if t else nothing for t in texts]
        ids_b, offsets_b = two.encode_many(texts)
        flat, starts, sizes = two.shown
        spelled = flat[ranges(starts[ids_b], sizes[ids_b])].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[ids_b])))[offsets_b].tolist()
        keep = np.zeros(n, dtype=bool)
        for k, t in enumerate(texts):
            if t:
                data = b" " + t.encode("utf-8", "surrogatepass")
                keep[k] = spelled[ends[k]:ends[k + 1]] == data and (one.ranked or one.spell(ids_a[k]) == data)
        self.a = np.concatenate([nothing, *(x for x, kept in zip(ids_a, keep) if kept)]).astype(np.int64)
        self.b = ids_b[ranges(offsets_b[:-1][keep], np.diff(offsets_b)[keep])].astype(np.int64)
        self.n_a = np.where(keep, np.fromiter(map(len, ids_a), dtype=np.int64, count=n), 0)
        self.n_b = np.where(keep, np.diff(offsets_b), 0)
        runs = shared_runs(np.cumsum(one.sizes[self.a]).tolist(), np.cumsum(sizes[self.b]).tolist())
        self.cut_a = ranges(runs[:, 0], runs[:, 2])  # last tokens of the groups
        self.cut_b = ranges(runs[:, 1], runs[:, 2])
        self.size_a, self.size_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        last = np.cumsum(self.n_a)  # each text's groups end where its tokens do
        self.groups_upto = np.searchsorted(self.cut_a, last)
        self.n_groups = np.diff(self.groups_upto, prepend=0)
        links = np.concatenate(([0], np.cumsum(self.size_a * self.size_b)))
        self.n_links = np.diff(links[self.groups_upto], prepend=0)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text: text, ``a * width + b``, and
        how many links each stands for; sorted."""
        text = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        count = self.size_a * self.size_b
        begin_a, begin_b = self.cut_a + 1 - self.size_a, self.cut_b + 1 - self.size_b
        small = count <= EXPANDED
        n, by = count[small], np.repeat(self.size_b[small], count[small])
        at = ranges(np.zeros(len(n), dtype=np.int64), n)
        a = self.a[np.repeat(begin_a[small], n) + at // by]
        b = self.b[np.repeat(begin_b[small], n) + at % by]
        span = np.int64(width) * (int(self.a.max(initial=0)) + 1)
        keys, times = np.unique(np.repeat(text[small], n) * span + a * width + b, return_counts=True)
        for g in np.flatnonzero(~small).tolist():
            x, nx = np.unique(self.a[begin_a[g]:self.cut_a[g] + 1], return_counts=True)
            y, ny = np.unique(self.b[begin_b[g]:self.cut_b[g] + 1], return_counts=True)
            keys = np.concatenate([keys, (text[g] * span + x[:, None] * width + y[None, :]).ravel()])
            times = np.concatenate([times, (nx[:, None] * ny[None, :]).ravel()])
        if not small.all():
            keys, where = np.unique(keys, return_inverse=True)
            summed = np.zeros(len(keys), dtype=np.int64)
            np.add.at(summed, where, times)
            times = summed
        return keys // span, keys % span, times

    def written(self, names: np.ndarray) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``.  ``names`` holds every
        id followed by a comma, a bar (ids of the first tokenizer) or a
        semicolon (of the second), in :func:`id_names`' order."""
        before_b = np.cumsum(self.size_b) - self.size_b
        upto_a = np.cumsum(self.size_a)
        where_a = np.arange(len(self.a)) + np.repeat(before_b, self.size_a)
        where_b = np.arange(len(self.b)) + np.repeat(upto_a, self.size_b)
        end_a, end_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        end_a[self.cut_a], end_b[self.cut_b] = 1, 2
        top = len(names) // 3
        tokens = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        tokens[where_a], tokens[where_b] = self.a + top * end_a, self.b + top * end_b
        parts = names[tokens].tolist()
        ends = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(ends, ends[1:])]


def id_names(count: int) -> np.ndarray:
    return np.array([f"{i}{end}" for end in ",|;" for i in range(count)], dtype=object)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, so many at a time that they hold few characters (a
    longer text comes alone)."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        start = size = 0
        for k, length in enumerate(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1])):
            if k > start and size + length > SLICE_CHARS:
                yield ids.slice(start, k - start), texts.slice(start, k - start).to_pylist()
                start, size = k, 0
            size += int(length)
        if len(ids) > start:
            yield ids.slice(start), texts.slice(start).to_pylist()


_LOADED: dict[bytes, tuple[ByteTokens, Pieces, np.ndarray]] = {}


def _load(one: bytes, two: bytes) -> tuple[ByteTokens, Pieces, np.ndarray]:
    """Both vocabularies and the names of their ids, once a worker process."""
    key = hashlib.sha256(one + two).digest()
    if key not in _LOADED:
        a, b = ByteTokens(one), Pieces(two)
        _LOADED[key] = a, b, id_names(max(a.size, len(b.pieces)))
    return _LOADED[key]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def _vocabularies(docs: DataFrame, *paths: str):
    ship_package(docs.sparkSession)
    data = []
    for path in paths:
        with open(path, "rb") as f:  # on the driver; tasks get the bytes
            data.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(data))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, one_path: str, two_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links`` and
    ``groups``, the ids of each group as ``a1,a2|b1;a3|b2,b3``.

    The first vocabulary encodes a space and the text, the second the text
    (it adds the space itself).  Texts that are null or empty, or that one of
    the two can't spell, have no tokens (zeros and ``''``).  Rows that repeat
    stay; an empty table gives no rows; other columns are ignored.
    """
    vocabularies = _vocabularies(docs, one_path, two_path)
    source = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, names = _load(*vocabularies.value)
        for ids, texts in _slices(batches):
            x = Aligned(texts, one, two)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.written(names), pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_COUNTS}, groups string")


class _Block:
    """Documents of one task whose pairs are sent and counted together."""

    def __init__(self, number: int):
        self.number, self.columns, self.sizes, self.pairs, self.times = number, [], [], [], []
        self.links = 0

    def add(self, ids: pa.Array, x: Aligned, names: np.ndarray, width: int) -> None:
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.written(names)]
        self.columns.append([ids, *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(digests, pa.string())])
        text, pair, times = x.pairs(width)
        self.sizes.append(np.bincount(text, minlength=len(ids)))
        self.pairs.append(pair)
        self.times.append(times)
        self.links += len(pair)

    def rows(self) -> pa.RecordBatch:
        """The documents' rows; the block's distinct pairs are dealt out over
        them."""
        n = sum(map(len, self.sizes))
        pairs, at, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        own = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes))))
        share = np.linspace(0, len(pairs), n + 1).astype(np.int64)
        columns = [pa.concat_arrays(c) for c in zip(*self.columns)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.number)), *columns, _lists(at.astype(np.int32), own),
             _lists(np.concatenate(self.times), own), _lists(pairs, share), _lists(docs.astype(np.int64), share)],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pair", "docs"])


def link_counts(docs: DataFrame, one_path: str, two_path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: the counts of :func:`align`, ``groups_sha256``
    (of the groups as written there; '' without tokens), ``n_best`` and
    ``count_sum``.

    The count of an id pair is the number of rows that hold it linked.
    ``n_best`` is how many of a text's links have the highest count of their
    first id (ties included), ``count_sum`` the sum of its links' counts.
    Null, empty and unspellable texts have zeros.  Rows that repeat count
    each; an empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "alignment")
    vocabularies = _vocabularies(docs, one_path, two_path)
    source = _texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    width = len(Pieces(vocabularies.value[1]).pieces)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, names = _load(*vocabularies.value)
        task, block = TaskContext.get().partitionId(), None
        for ids, texts in _slices(batches):
            if block is None:
                block, task = _Block(task), task + (1 << 32)
            block.add(ids, Aligned(texts, one, two), names, width)
            if block.links >= BLOCK_LINKS:
                yield block.rows()
                block = None
        if block is not None:
            yield block.rows()

    dealt = work.stage(source.mapInArrow(
        deal, f"block long, doc_id {id_type}, {_COUNTS}, groups_sha256 string, at array<int>, times array<long>, "
              "pair array<long>, docs array<long>"), "dealt")
    sent = dealt.select("block", F.explode(F.arrays_zip("pair", "docs")).alias("s")).select("block", "s.*")
    total = sent.groupBy("pair").agg(F.sum("docs").alias("total"))
    highest = total.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("total").alias("highest"))
    counts = (total.withColumn("a", F.expr(f"pair div {width}")).join(highest, "a")
              .select("pair", "total", (F.col("total") == F.col("highest")).alias("best")))
    returned = sent.select(F.col("block").alias("to"), "pair").join(counts, "pair")

    def settle(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs.column("pair").to_numpy())  # pairs were numbered in this order
        total = theirs.column("total").to_numpy()[order]
        best = theirs.column("best").to_numpy(zero_copy_only=False)[order]
        at, times = (mine.column(c).combine_chunks() for c in ("at", "times"))
        ends = at.offsets.to_numpy() - at.offsets[0].as_py()
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy()
        sums = [np.concatenate(([0], np.cumsum(v)))[ends] for v in (times * best[at], times * total[at])]
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        return pa.table([*(mine.column(c) for c in kept), *(pa.array(np.diff(s)) for s in sums)],
                        names=[*kept, "n_best", "count_sum"])

    return dealt.drop("pair", "docs").groupBy("block").cogroup(returned.groupBy("to")).applyInArrow(
        settle, f"doc_id {id_type}, {_COUNTS}, groups_sha256 string, n_best long, count_sum long")
