"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces walks a text once.  At each end
position its output links list the pieces that end there, longest first, and
each relaxes the best way to reach that position:

* unigram models: the way with the largest sum of piece scores;
* BPE models: a way counts only if its last two pieces are stable, i.e. the
  merges of the model turn the two pieces' characters into just these two.
  For every prefix exactly one way is stable throughout, and it is the one
  that the merges by score give.

A piece with the white-space mark has it at its front only, so texts are cut
before each run of marks and each segment is encoded on its own; segments
recur, so their ids are kept in a bounded table.  The missing segments of a
batch go through the automaton together.

Characters without a piece become their UTF-8 bytes where the model has byte
pieces, else the unknown id.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship_package
from .common import quoted

MARK = "▁"
KEPT_SEGMENTS, KEPT_IDS = 1 << 19, 1 << 23
LONGEST_QUICK = 64
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            value, at = data[at:at + width], at + width
        else:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Memo(dict):
    """Segments and their numbers; a new segment gets the next one and waits
    in ``new`` for its ids.  All ids lie in one growing array."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = self.used = 0
        self.ids = np.empty(1 << 12, dtype=np.int32)
        self.starts, self.sizes = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.new.append(segment)
        self.chars += len(segment)
        return number

    def full(self) -> bool:
        return len(self) >= KEPT_SEGMENTS or self.used >= KEPT_IDS or self.chars >= KEPT_IDS

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.empty(max(size, len(array)), array.dtype)])

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids (in a row) of the segments of these numbers."""
        self.starts, self.sizes = self._room(self.starts, len(self)), self._room(self.sizes, len(self))
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments in a row, and how many each has."""
        sizes = self.sizes[at]
        return self.ids[ranges(self.starts[at], sizes)], sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class Pairs:
    """A table from pairs of ids to truth, with open addressing."""

    SLOTS_LOG = 21

    def __init__(self):
        self.keys = np.full(1 << self.SLOTS_LOG, -1, dtype=np.int64)
        self.holds = np.zeros(1 << self.SLOTS_LOG, dtype=bool)
        self.count = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.SLOTS_LOG)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair holds, and which pairs aren't in the table."""
        at = self._slot(keys)
        seen = self.keys[at]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            seen[todo] = self.keys[at[todo]]
            todo = todo[(seen[todo] != keys[todo]) & (seen[todo] >= 0)]
        return self.holds[at], seen < 0

    def put(self, key: int, holds: bool) -> None:
        if self.count >= len(self.keys) // 2:
            self.__init__()
        at = int(self._slot(np.array([key]))[0])
        while self.keys[at] >= 0 and self.keys[at] != key:
            at = (at + 1) % len(self.keys)
        self.count += self.keys[at] < 0
        self.keys[at], self.holds[at] = key, holds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Walk:
    """The automaton over words of two characters and more as arrays, for
    many texts at once.  ``step[state, column[character]]`` is the next state;
    ``output[state]`` the state of the longest word that ends there (0: none),
    ``shorter`` of an output state the next shorter one (its output link) and
    ``piece`` its word's id."""

    def __init__(self, words: dict[str, int]):
        letters = sorted(set("".join(words)))
        self.column = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(letters):
            self.column[ord(c)] = k + 1
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for word, i in words.items():
            node = 0
            for k in self.column[[ord(c) for c in word]].tolist():
                child = children[node].get(k)
                if child is None:
                    child = children[node][k] = len(children)
                    children.append({})
                    piece.append(-1)
                node = child
            piece[node] = i
        n = len(children)
        self.step = np.zeros((n, len(letters) + 1), dtype=np.int32)
        self.piece = np.array(piece, dtype=np.int64)
        self.output, self.shorter = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        queue, fail = [0], [0] * n
        for node in queue:  # by depth, so the states of suffixes are complete
            if node:
                self.step[node] = self.step[fail[node]]
                ends = self.output[fail[node]]
                self.output[node], self.shorter[node] = (node, ends) if piece[node] >= 0 else (ends, 0)
            for k, child in children[node].items():
                fail[child] = int(self.step[fail[node], k]) if node else 0
                self.step[node, k] = child
                queue.append(child)


class Pieces:
    """A SentencePiece model with identity normalization."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("models with white space as a suffix are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                self.escape = bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for t in self.types):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        normal = [i for i, t in enumerate(self.types) if t == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.unknown = self.types.index(UNKNOWN)
        byte_at = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_ids = [byte_at[b] for b in range(256)] if self.byte_fallback else []
        self.byte_of = {i: b for b, i in byte_at.items()}
        self.unknown_score = min((self.scores[i] for i in normal), default=0.0) - 10.0
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        other = f"[^{MARK}{lone}]"
        self.cut = None if inner else re.compile(f"{MARK}+{other}*|{other}+" + (f"|{lone}" if lone else "")).findall
        self.memo = Memo()
        self.stable = Pairs()  # by the ids of two neighbours
        self.char_ids = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.char_table = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.char_ids.items():
            self.char_table[ord(c)] = i
        self.sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.rank = {self.pieces[i]: -self.scores[i] for i in normal}
        shift = min(self.rank.values(), default=0.0)
        self.rank = {p: r - shift for p, r in self.rank.items()}  # from 0 up
        self.halves: dict[str, tuple[str, str] | None] = {}

    # -- encoding -----------------------------------------------------------

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Matches all pieces.  BPE needs none for lone characters: they are
        what is left."""
        out = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.kind == UNIGRAM or len(piece) > 1:
                out.add_word(piece, i)
        out.make_automaton()
        return out

    @cached_property
    def walk(self) -> Walk:
        return Walk({p: i for p, i in self.ids.items() if len(p) > 1})

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids."""
        return self.encode_many([text])[0].tolist()

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one
        offset more than texts).

        Each distinct segment is encoded once and its ids kept; the ids of
        the texts are gathered from there.
        """
        if self.memo.full():
            self.memo = Memo()
        memo, cut = self.memo, self.cut or (lambda t: [t] if t else [])
        parts = [cut(self.normalize(t or "")) for t in texts]
        flat = chain.from_iterable(parts)
        at = np.fromiter(map(memo.__getitem__, flat), dtype=np.int64, count=sum(map(len, parts)))
        if memo.new:
            new, memo.new = memo.new, []
            number = len(memo) - len(new)
            quick = self._quick(new) if self.kind == BPE else np.zeros(len(new), dtype=bool)
            if quick.any():
                numbers = np.flatnonzero(quick)
                memo.put(number + numbers, *self._side_by_side([new[k] for k in numbers]))
            for k in np.flatnonzero(~quick).tolist():
                ids = np.array(self._segment(new[k]), dtype=np.int32)
                memo.put(np.array([number + k]), ids, np.array([len(ids)]))
        ids, sizes = memo.take(at)
        ends = np.cumsum([0, *map(len, parts)])
        return ids, np.concatenate(([0], np.cumsum(sizes)))[ends]

    def _segment(self, text: str) -> tuple[int, ...]:
        # back[p], last[p]: size and id of the last piece of the best way to p.
        last = [0, *map(self.char_ids.get, text)]
        if None in last:
            last = [0, *(self.char_ids.get(c, ~ord(c)) for c in text)]
        back = (self._stable_ways if self.kind == BPE else self._best_ways)(text, last)
        out: list[int] = []
        p = len(text)
        while p:
            i = last[p]
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in reversed(text[p - 1].encode("utf-8", "surrogatepass"))]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            p -= back[p]
        return tuple(reversed(out))

    def _quick(self, segments: list[str]) -> np.ndarray:
        """Which segments are short and have only characters with a piece."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        known = self.char_table[_codes("".join(segments))] >= 0
        return np.minimum.reduceat(known, np.cumsum(sizes) - sizes) & (sizes <= LONGEST_QUICK)

    def _side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments of a BPE model in a row, and how many each has.

        All segments take their next character together, so that the pieces
        which end at a place are looked at, longest first, when all before it
        is settled.
        """
        walk = self.walk
        codes = _codes("".join(segments))
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        last = self.char_table[codes].astype(np.int64)
        letters = walk.column[codes]
        first = np.cumsum(sizes) - sizes  # of each segment's characters
        back = np.ones(len(codes), dtype=np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        begins, deep = first[by_size], sizes[by_size]
        state = np.zeros(len(segments), dtype=np.int64)
        for p in range(int(deep[0])):
            live = int(np.searchsorted(-deep, -p))  # segments longer than p
            at = begins[:live] + p
            state[:live] = walk.step[state[:live], letters[at]]
            # Pieces that end here, longest first, until one is stable.
            out = walk.output[state[:live]]
            where = np.flatnonzero(out)
            out = out[where]
            while len(where):
                piece = walk.piece[out]
                n = self.sizes[piece]
                inner = n <= p
                here = at[where]
                before = last[here - n]
                holds = self._stable_pairs(np.where(inner, before, -1), piece)
                won = here[holds]
                last[won], back[won] = piece[holds], n[holds]
                out = walk.shorter[out[~holds]]
                where = where[~holds][out > 0]
                out = out[out > 0]
        # Walk back from the end of every segment at once.
        at, live, steps = first + sizes - 1, np.arange(len(segments)), []
        while len(live):
            steps.append((live, last[at]))
            at = at - back[at]
            going = at >= first[live]
            at, live = at[going], live[going]
        counts = np.zeros(len(segments), dtype=np.int64)
        for live, _ in steps:
            counts[live] += 1
        place = np.cumsum(counts) - 1
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        for live, found in steps:
            ids[place[live]] = found
            place[live] -= 1
        return ids, counts

    def _stable_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of neighbours whether it is stable (``left`` is -1
        where a text begins)."""
        keys = (left + 1) * len(self.pieces) + right
        holds, new = self.stable.find(keys)
        if new.any():
            for key in np.unique(keys[new]).tolist():
                a, b = divmod(key, len(self.pieces))
                self.stable.put(key, self._border_holds(self.pieces[a - 1] if a else "", self.pieces[b]))
            holds[new] = self.stable.find(keys[new])[0]
        return holds

    def _best_ways(self, text: str, last: list[int]) -> list[int]:
        n, scores = len(text), self.scores
        self.lone = list(last)
        best, back = [0.0] + [-float("inf")] * n, [1] * (n + 1)
        at = 0  # positions up to here are final
        for end, i in self.automaton.iter(text):
            end += 1
            size = len(self.pieces[i])
            while at < end - 1:
                at += 1
                self._relax_unknown(last, at, best, back)
            way = best[end - size] + scores[i]
            if way > best[end]:
                best[end], back[end] = way, size
                last[end] = i
        while at < n:
            at += 1
            self._relax_unknown(last, at, best, back)
        return back

    def _relax_unknown(self, last: list[int], end: int, best: list[float], back: list[int]) -> None:
        """The character before ``end``, if it has no piece (a longer piece
        may end there too)."""
        lone = self.lone[end]
        if lone < 0:
            way = best[end - 1] + self.unknown_score
            if way > best[end]:
                best[end], back[end], last[end] = way, 1, lone

    def _stable_ways(self, text: str, last: list[int]) -> list[int]:
        back = [1] * (len(text) + 1)  # a lone character, unless a longer piece is stable
        settled, known, width = 0, {}, len(self.pieces)
        for end, i in self.automaton.iter(text):
            end += 1
            if end == settled:
                continue
            size = len(self.pieces[i])
            start = end - size
            key = (last[start] if start else width, i)
            holds = known.get(key)
            if holds is None:
                left = text[start - back[start]:start] if start else ""
                holds = known[key] = self._border_holds(left, text[start:end])
            if holds:
                back[end], last[end], settled = size, i, end
        return back

    def _border_holds(self, left: str, right: str) -> bool:
        """Whether the merges of ``left + right`` end in just these two
        (``left`` may be empty).

        Merges happen in order of score, the leftmost of equal ones first.
        Going back in time, the later of the two pieces at the border is
        undone, and each pair that stood side by side there is looked at: had
        it a merge that came before the one undone, the border would be gone.
        """
        if self._halves(right) is None:
            return False
        if not left:
            return True
        if self._halves(left) is None:
            return False
        rank, limit, equal = self.rank, float("inf"), False
        while True:
            crossing = rank.get(left + right)
            if crossing is not None and (crossing < limit or equal and crossing == limit):
                return False
            a = rank[left] if len(left) > 1 else -1.0
            b = rank[right] if len(right) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, equal, left = a, False, self._halves(left)[1]
            else:  # equal ranks: the one to the left came first
                limit, equal, right = b, True, self._halves(right)[0]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the piece's last merge; None if merges never
        make it.  A lone character is made of itself."""
        if len(piece) == 1:
            return piece, ""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:])]
                k = ranks.index(min(ranks))
                if ranks[k] == float("inf"):
                    last = None
                    break
                last = (parts[k], parts[k + 1])
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.halves[piece] = last
        return self.halves[piece]

    # -- decoding -----------------------------------------------------------

    @cached_property
    def shown(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The UTF-8 bytes that ids stand for, in a row, where each id's
        begin, and how many it has."""
        def spelled(i: int) -> bytes:
            if self.types[i] == BYTE:
                return bytes([self.byte_of[i]])
            text = {NORMAL: self.pieces[i], UNKNOWN: " \u2047 "}.get(self.types[i], "")
            return (text.replace(MARK, " ") if self.escape else text).encode("utf-8")

        spelling = [spelled(i) for i in range(len(self.pieces))]
        sizes = np.array([len(x) for x in spelling], dtype=np.int64)
        return np.frombuffer(b"".join(spelling), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        return self.decode_many(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids between each offset and the next."""
        flat, starts, sizes = self.shown
        data = flat[ranges(starts[ids], sizes[ids])].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[ids])))[offsets].tolist()
        out = []
        for a, b in zip(ends, ends[1:]):
            text = data[a:b].decode("utf-8", "replace")
            if self.byte_ids and self.escape and MARK in text:  # spelled by byte pieces
                text = text.replace(MARK, " ")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


_LOADED: dict[bytes, Pieces] = {}


def load(proto: bytes) -> Pieces:
    """One model per worker process."""
    key = hashlib.sha256(proto).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; tasks get the bytes
        return f.read()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that few results are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, ids array<int>, n_pieces long``, and
    with ``decoded`` the text that the ids stand for.

    Null and empty texts have no ids.  An empty table gives no rows; other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto.value)
        for batch in _slices(batches):
            ids, offsets = model.encode_many(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"),
                       pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                       pa.array(np.diff(offsets))]
            if decoded:
                columns.append(pa.array(model.decode_many(ids, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "decoded"][:len(columns)])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long"
                              + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``out_col``, which replaces a
    column of that name.  Null ids: null; no ids: an empty text; rows that
    repeat stay; an empty table gives no rows.
    """
    encoded = encoded.drop(out_col)
    ship_package(encoded.sparkSession)
    proto = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto.value)
        for batch in _slices(batches):
            texts = [None if x.values is None else model.decode(x.values.to_numpy().tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_col, StringType())]))
