"""Keyed state on streams (``transformWithState``, RocksDB).

Both processors keep a small state per key and emit *changes*: a micro-batch
writes rows for the keys it touched and for nothing else, and RocksDB's
changelog checkpoints upload what changed.  What readers see is put together
from the changes by ordinary (skew-safe) jobs.

* :class:`ListFold` (OP-30): the candidate list of a session.
* :class:`Supersede` (OP-40): a repo's newest snapshot, with retractions of
  what the snapshot before it contributed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.candidates import (ADD, COMMITTED, DONE, ERROR, LIST_RESETS, REORDER, SET_LOADING, SET_STAGED_FILES,
                                    TOGGLE, UPDATE_MESSAGE)

# Spark starts one more Python process on the driver to look at a processor;
# it has no package of ours on its path, so processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (a query remembers
    its provider)."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# ---------------------------------------------------------------------------
# OP-30
# ---------------------------------------------------------------------------

_ITEM = ["id", "message", "reason", "files", "checked"]
_PAYLOAD = "array<struct<id:string,message:string,reason:string,files:array<string>,checked:boolean>>"
_EVENT = f"seq long, type string, id string, message string, reason string, files array<string>, payload {_PAYLOAD}"
_Event = Row(*(c.split()[0] for c in _EVENT.split(", ", 6)))
EVENT_COLUMNS = ["session", "seq", "type", "id", "message", "reason", "files", "count", "payload"]
_LIST_EVENTS = {*LIST_RESETS, ADD, TOGGLE, UPDATE_MESSAGE}
_STATUS = ("gen_seq long, generating boolean, err_seq long, error string, ok_seq long, success_count int, "
           "staged_loading boolean, base_seq long, last_seq long, list_seq long, epoch long, seen_ms long, closed boolean")
STATUS, ENTRY, TOUCH, LATE = "status", "entry", "touch", "late"
CHANGES = ("session long, kind string, epoch long, generating boolean, error string, success_count int, "
           "staged_loading boolean, base_seq long, last_seq long, seq long, sub_pos int, id string, message string, "
           "reason string, files array<string>, checked boolean, toggles long")
_CHANGE = [c.split()[0] for c in CHANGES.split(", ")]


def _plain(items, names: list[str]) -> list[tuple | None]:
    """Structs of an array as tuples: they come as dicts or rows."""
    return [None if x is None else tuple(x[n] for n in names) for x in items or []]


def _change(session, kind: str, epoch: int, **values) -> Row:
    return Row(**{c: None for c in _CHANGE} | {"session": session, "kind": kind, "epoch": epoch} | values)


class _Status:
    """The scalars of a session; each keeps the seq of the event that set it,
    so events may come in any order."""

    NAMES = [c.split()[0] for c in _STATUS.split(", ")]

    def __init__(self, stored=None):
        first = dict.fromkeys(self.NAMES) | {"generating": False, "staged_loading": True, "epoch": 0, "closed": False}
        self.__dict__.update(first if stored is None else dict(zip(self.NAMES, stored)))

    def stored(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def _newer(self, name: str, seq: int) -> bool:
        if getattr(self, name) is not None and getattr(self, name) > seq:
            return False
        setattr(self, name, seq)
        return True

    def take(self, e: Row) -> None:
        if e.type in (SET_LOADING, DONE, ERROR) and self._newer("gen_seq", e.seq):
            self.generating = e.type == SET_LOADING
        if e.type in (SET_LOADING, ERROR) and self._newer("err_seq", e.seq):
            self.error = e.message if e.type == ERROR else None
        if e.type in (SET_LOADING, COMMITTED) and self._newer("ok_seq", e.seq):
            self.success_count = e["count"] if e.type == COMMITTED else None
        if e.type == SET_STAGED_FILES:
            self.staged_loading = False
        self._newer("last_seq", e.seq)

    def change(self, session) -> Row:
        return _change(session, STATUS, self.epoch, generating=self.generating, error=self.error,
                       success_count=self.success_count, staged_loading=self.staged_loading, base_seq=self.base_seq,
                       last_seq=self.last_seq)


class ListFold(StatefulProcessor):
    """Folds UI events into changes of candidate lists.

    A list restarts at every SET_LOADING, COMMITTED and REORDER; what belongs
    to it from there on carries the session's ``epoch``.  An entry is emitted
    once, with the toggles its id had before; a touched id is emitted with its
    toggles so far and its last edit.  So an event costs a few state rows,
    however long the list is.

    State per session: the scalars (value state), the touched ids of the
    current list (map state), and the events since its start (list state).  A
    late event older than the start changes scalars only; a later one has the
    list folded anew from those events under a new epoch, exactly.

    With ``idle_ms`` a timer drops the events of a session that was idle for
    so long; what arrives late for its list afterwards is emitted as ``late``
    instead of being applied wrongly.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", _STATUS)
        self.touches = handle.getMapState("touches", "id string", "toggles long, edit_seq long, edit string")
        self.events = handle.getListState("events", _EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session = key[0]
        batch = sorted(rows, key=lambda e: e.seq)
        status = _Status(self.status.get() if self.status.exists() else None)
        for e in batch:
            status.take(e)
        mine = [e for e in batch if e.type in _LIST_EVENTS and (status.base_seq is None or e.seq > status.base_seq)]
        if mine and status.list_seq is not None and mine[0].seq < status.list_seq:
            if status.closed:
                late = [e for e in mine if e.seq < status.list_seq]
                mine = [e for e in mine if e.seq >= status.list_seq]
                yield from (_change(session, LATE, status.epoch, seq=e.seq, id=e.id, message=e.message) for e in late)
            else:
                mine = sorted([*(_Event(*e) for e in self.events.get()), *mine], key=lambda e: e.seq)
                status.epoch += 1
                yield from self._fold(session, status, mine, anew=True)
                mine = []
        if mine:
            yield from self._fold(session, status, mine, anew=False)
        if self.idle_ms is not None:
            status.seen_ms = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(status.seen_ms + self.idle_ms)
        self.status.update(status.stored())
        yield status.change(session)

    def _fold(self, session, status: _Status, events: list[Row], anew: bool) -> Iterator[Row]:
        entries: list[Row] = []
        live: dict[str, list] = {}
        kept: list[Row] = []

        def touched(id_: str) -> list:
            if id_ not in live:
                stored = self.touches.getValue((id_,)) if not anew and self.touches.containsKey((id_,)) else None
                live[id_] = [*(stored or (0, None, None)), False]
            return live[id_]

        def add(e: Row, sub_pos: int, item: list, checked: bool) -> None:
            before = touched(item[0])[0] if item[0] is not None else 0
            entries.append(_change(session, ENTRY, status.epoch, seq=e.seq, sub_pos=sub_pos, checked=checked,
                                   toggles=before, **dict(zip(_ITEM, item))))

        for e in events:
            if e.type in LIST_RESETS:
                if not (anew and e.seq == status.base_seq):  # its own start, when folded anew
                    status.epoch += 1
                status.base_seq, anew = e.seq, True
                entries, live, kept = [], {}, []
                for k, item in enumerate(_plain(e.payload, _ITEM) if e.type == REORDER else []):
                    *values, checked = item or [None] * len(_ITEM)
                    add(e, k, values, bool(checked))
            elif e.type == ADD:
                add(e, 0, [e.id, e.message, e.reason, e.files], True)
            elif e.id is not None:
                touch = touched(e.id)
                touch[3] = True
                if e.type == TOGGLE:
                    touch[0] += 1
                else:
                    touch[1:3] = e.seq, e.message
            kept.append(e)
        status.list_seq = events[-1].seq
        stored = [(e.seq, e.type, e.id, e.message, e.reason, e.files, _plain(e.payload, _ITEM)) for e in kept]
        if anew:
            self.touches.clear()
            self.events.put(stored)
        else:
            self.events.appendList(stored)
        yield from entries
        for id_, (toggles, edit_seq, edit, changed) in live.items():
            if changed:
                self.touches.updateValue((id_,), (toggles, edit_seq, edit))
                yield _change(session, TOUCH, status.epoch, id=id_, toggles=toggles, seq=edit_seq, message=edit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status = _Status(self.status.get())
        if expiredTimerInfo.getExpiryTimeInMs() >= status.seen_ms + self.idle_ms:  # nothing came since
            self.events.clear()
            status.closed = True
            self.status.update(status.stored())
        return iter(())

    def close(self) -> None:
        pass


def list_changes(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The changes (``CHANGES``) of a stream of UI events."""
    return events.select(*EVENT_COLUMNS).groupBy("session").transformWithState(
        ListFold(idle_ms), CHANGES, "Update", "None" if idle_ms is None else "ProcessingTime")


# ---------------------------------------------------------------------------
# OP-40
# ---------------------------------------------------------------------------

_GROUP = ["group_type", "files", "additions", "deletions"]
_GROUPS = "array<struct<group_type:string,files:long,additions:long,deletions:long>>"
SIGNED = "repo string, commit_id long, sign int, group_type string, files long, additions long, deletions long"


class Supersede(StatefulProcessor):
    """Signed rows: what a repo's newest snapshot contributes (sign 1), and
    what the one it supersedes did (sign -1).  A snapshot that comes late,
    behind a newer one, contributes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", f"commit_id long, groups {_GROUPS}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: r.commit_id)
        old = self.newest.get() if self.newest.exists() else None
        if old is not None and old[0] >= new.commit_id:
            return
        groups = _plain(new.groups, _GROUP)
        self.newest.update((new.commit_id, groups))
        before = (old[0], _plain(old[1], _GROUP)) if old is not None else (None, [])
        for sign, commit_id, rows in ((-1, *before), (1, new.commit_id, groups)):
            for row in rows:
                yield Row(repo=key[0], commit_id=commit_id, sign=sign, **dict(zip(_GROUP, row)))

    def close(self) -> None:
        pass


def superseding(snapshots: DataFrame) -> DataFrame:
    """The signed rows (``SIGNED``) of a stream of ``repo, commit_id, groups``."""
    return snapshots.groupBy("repo").transformWithState(Supersede(), SIGNED, "Update", "None")
