"""Drags of list items composed into one map per list (OP-32).

A drag moves one item and shifts those between by one: a permutation that is
a shift on each of at most four index ranges.  Two such maps compose to a
third of the same kind, whatever comes before or after, so a list's drags are
merged in any grouping that keeps their order: first within ranges of
``seq``, then over a list's ranges.  A map never has more pieces than the list
has items, nor than three times its drags and one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

RANGE = 1 << 16  # numbers of ``seq`` whose drags one task merges first

# Starts of the pieces, ascending from 0, and what is added within each.
Shifts = tuple[np.ndarray, np.ndarray]


def drag(i: int, j: int, n: int) -> Shifts:
    """The item at ``i`` goes to ``j`` (different, both within 0..n-1)."""
    if i < j:
        pieces = [(0, 0), (i, j - i), (i + 1, -1), (j + 1, 0)]
    else:
        pieces = [(0, 0), (j, 1), (i, j - i), (i + 1, 0)]
    kept = [p for p, after in zip(pieces, pieces[1:] + [(n, 0)]) if p[0] < after[0]]
    starts, shifts = zip(*kept)
    return np.array(starts, np.int64), np.array(shifts, np.int64)


def then(first: Shifts, second: Shifts) -> Shifts:
    """``first`` and then ``second`` as one map."""
    images = first[0] + first[1]
    order = np.argsort(images)
    images = images[order]
    # Every place, between the two, where one of them begins a new piece.
    points = np.union1d(images, second[0])
    a = order[np.searchsorted(images, points, "right") - 1]
    b = np.searchsorted(second[0], points, "right") - 1
    starts, shifts = points - first[1][a], first[1][a] + second[1][b]
    order = np.argsort(starts)
    starts, shifts = starts[order], shifts[order]
    new = np.append(True, shifts[1:] != shifts[:-1])
    return starts[new], shifts[new]


def merged(maps: list[Shifts]) -> Shifts:
    """All of ``maps`` in turn, merged pair by pair."""
    while len(maps) > 1:
        maps = [then(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


def _grouped(batches: Iterator[pa.RecordBatch], read: Callable[[list[tuple]], list[Shifts]],
             types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Merges each run of rows with equal first two columns (list, range);
    the third is the length of the list."""
    names = ["key", "range", "n", "start", "end", "shift"]
    out: list[tuple] = []
    held: list[tuple] = []

    def settle() -> None:
        starts, shifts = merged(read(held))
        n = held[0][2]
        ends = [*starts[1:].tolist(), n]
        out.extend((*held[0][:3], *piece) for piece in zip(starts.tolist(), ends, shifts.tolist()))

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                settle()
                held.clear()
                if len(out) >= 1 << 16:
                    yield flush()
            held.append(row)
    if held:
        settle()
    yield flush()


def _drags(rows: list[tuple]) -> list[Shifts]:
    return [drag(i, j, n) for _, _, n, _, i, j in rows]


def _maps(rows: list[tuple]) -> list[Shifts]:
    """Pieces in order of their map and start, apart again."""
    part, starts, shifts = (np.array(c, np.int64) for c in zip(*((r[3], r[4], r[5]) for r in rows)))
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    return list(zip(np.split(starts, cuts), np.split(shifts, cuts)))


def composed(moves: DataFrame, span: int = RANGE) -> DataFrame:
    """``key, start, end, shift``: what all drags of a list together add to
    the positions ``start`` to ``end`` (exclusive).

    ``moves``: ``key``, ``n`` (length of the list), ``seq``, and ``i``, ``j``
    as in ``drag``.  Drags with one ``seq`` follow each other by ``i, j``.
    """
    ship_package(moves.sparkSession)
    key_type = moves.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, range long, n long, start long, end long, shift long"

    def merge(rows: DataFrame, order: list[str], read) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return
            types = [first.schema.field(0).type] + [pa.int64()] * 5

            def everything():
                yield first
                yield from batches
            yield from _grouped(everything(), read, types)
        dealt = rows.repartition("key", "range").sortWithinPartitions("key", "range", *order)
        return dealt.mapInArrow(run, schema)
    ranges = merge(moves.select("key", F.floor(F.col("seq") / span).cast("long").alias("range"), "n", "seq", "i", "j"),
                   ["seq", "i", "j"], _drags)
    lists = merge(ranges.select("key", F.lit(0).cast("long").alias("range"), "n", F.col("range").alias("part"),
                                "start", "shift"), ["part", "start"], _maps)
    return lists.select("key", "start", "end", "shift")
