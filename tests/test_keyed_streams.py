"""Keyed state on streams: what a batch writes, late events, retractions."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from commitscope.operators import candidates as C
from commitscope.operators import churn
from commitscope.streaming import jobs, keyed

TYPES = [C.SET_LOADING, C.ADD, C.ADD, C.ADD, C.ADD, C.TOGGLE, C.TOGGLE, C.TOGGLE, C.UPDATE_MESSAGE, C.UPDATE_MESSAGE,
         C.REORDER, C.COMMITTED, C.DONE, C.ERROR, C.SET_STAGED_FILES]


def _event(rng, session, seq):
    kind = rng.choice(TYPES)
    payload = [{"id": rng.choice("abc"), "message": f"p{seq}{k}", "reason": None, "files": ["f"], "checked": rng.random() < .5}
               for k in range(rng.randint(0, 3))] if kind == C.REORDER else None
    return (session, seq, kind, rng.choice(["a", "b", "c", None]), f"m{seq}", "r", [f"x{seq}"], rng.randint(0, 9), payload,
            None, None, None, None, None)


def _lists(df):
    return sorted(map(str, df.select("session", "list_pos", "id", "message", "reason", "files", "checked").collect()))


def _run(spark, base, batches):
    for n, events in enumerate(batches):
        spark.createDataFrame(events, C.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(C.EVENT_SCHEMA).parquet(f"{base}/in")
        jobs.run_fold_stream(src, base)


def test_events_in_any_order_give_the_batch_result(spark, tmp_path):
    rng = random.Random(11)
    events = [_event(rng, s, q) for s in range(12) for q in range(rng.randint(1, 40))]
    rng.shuffle(events)
    base = str(tmp_path / "late")
    _run(spark, base, [events[:150], events[150:170], events[170:]])
    everything = spark.createDataFrame(events, C.EVENT_SCHEMA)
    assert _lists(jobs.latest_lists(spark, base)) == _lists(C.list_positions(C.fold_candidates(everything)))
    cols = ["session", "generating", "error", "success_count", "staged_loading", "base_seq"]
    assert sorted(map(str, jobs.latest_status(spark, base).select(*cols).collect())) == sorted(
        map(str, C.session_status(everything).select(*cols).collect()))


def test_a_batch_writes_in_proportion_to_its_events(spark, tmp_path):
    base = str(tmp_path / "few")
    adds = [(s, q, C.ADD, f"i{q}", "m", "r", ["f"], None, None, None, None, None, None, None)
            for s in range(30) for q in range(20)]
    touch = [(7, 20, C.TOGGLE, "i3", None, None, None, None, None, None, None, None, None, None),
             (7, 21, C.UPDATE_MESSAGE, "i4", "new", None, None, None, None, None, None, None, None, None)]
    _run(spark, base, [adds, touch])
    changes = spark.read.schema(keyed.CHANGES + ", batch_id long").parquet(f"{base}/changes")
    per_batch = {r.batch_id: (r.n, r.s) for r in changes.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.countDistinct("session").alias("s")).collect()}
    assert per_batch == {0: (30 * 20 + 30, 30), 1: (3, 1)}  # entries and a status each; two touched ids and a status
    shown = {(r.session, r.id): (r.checked, r.message) for r in jobs.latest_lists(spark, base).collect()}
    assert shown[7, "i3"] == (False, "m") and shown[7, "i4"] == (True, "new") and len(shown) == 600


class _State:
    """State of one key in memory."""

    def __init__(self):
        self.value, self.items = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    def put(self, values):
        self.value = list(values)

    def appendList(self, values):
        self.value = [*(self.value or []), *values]

    def clear(self):
        self.value, self.items = None, {}

    def containsKey(self, key):
        return key in self.items

    def getValue(self, key):
        return self.items[key]

    def updateValue(self, key, value):
        self.items[key] = value


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _State()

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_idle_sessions_drop_their_events_and_report_late_ones():
    names = keyed.EVENT_COLUMNS
    make = lambda seq, kind, id_: Row(*names)(1, seq, kind, id_, f"m{seq}", None, [], None, None)
    fold, handle = keyed.ListFold(idle_ms=100), _Handle()
    fold.init(handle)
    first = list(fold.handleInputRows((1,), iter([make(5, C.ADD, "a"), make(9, C.ADD, "b")]), _Now(0)))
    assert [r.kind for r in first] == ["entry", "entry", "status"] and handle.timers == [100]
    list(fold.handleInputRows((1,), iter([make(10, C.TOGGLE, "a")]), _Now(50)))
    list(fold.handleExpiredTimer((1,), _Now(100), _Now(100)))   # was touched at 50
    assert not fold.status.get()[-1] and len(fold.events.value) == 3
    list(fold.handleExpiredTimer((1,), _Now(150), _Now(150)))
    assert fold.status.get()[-1] and fold.events.value is None
    out = list(fold.handleInputRows((1,), iter([make(7, C.TOGGLE, "a"), make(12, C.TOGGLE, "b")]), _Now(200)))
    assert [(r.kind, r.seq) for r in out][0] == ("late", 7)
    assert [(r.kind, r.id, r.toggles) for r in out][1] == ("touch", "b", 1)


def test_newer_snapshots_take_back_what_older_ones_gave(spark, tmp_path):
    rng = random.Random(4)
    paths = ["src/a.ts", "README.md", "package.json", "src/a.test.ts", "x.css"]

    def snapshot():
        files = rng.sample(paths, rng.randint(0, 4))
        return "".join(f"diff --git a/{p} b/{p}\n@@ -1 +1 @@\n" + "+x\n" * rng.randint(0, 5) + "-y\n" * rng.randint(0, 3)
                       for p in files) or "  \n"

    rows = [(f"r{rng.randint(0, 6)}", k, snapshot()) for k in rng.sample(range(500), 60)]
    base = str(tmp_path / "churn")
    schema = "repo string, commit_id long, raw_diff string"
    for part in (rows[:25], rows[25:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{base}/in")
        jobs.run_superseding_churn(spark.readStream.schema(schema).parquet(f"{base}/in"), base)
    newest = {}
    for r in rows:
        newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[1])
    want = churn.churn_totals(jobs.file_churn_stream(spark.createDataFrame(list(newest.values()), schema)),
                              ["repo", "group_type"])
    got = jobs.latest_churn(spark, base)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    signed = spark.read.parquet(f"{base}/signed")
    assert {r.sign for r in signed.select("sign").distinct().collect()} == {1, -1}
