import random

import pandas as pd
from pyspark.sql import functions as F

from commitscope.operators import candidates as C
from commitscope.operators import drags
from commitscope.plans.commit_plan import commit_plan


def _events(spark, evs):
    rows = []
    for i, (t, cid, msg, count, payload) in enumerate(evs):
        rows.append((1, i, t, cid, msg, f"why {i}" if t == C.ADD else None, [f"f{i}"] if t == C.ADD else None, count,
                     payload and [(p[0], p[1], f"moved {i}", [f"g{i}"], p[2]) for p in payload], None, None, None, None,
                     None))
    return spark.createDataFrame(rows, C.EVENT_SCHEMA)


def _fold_py(evs):
    """Reference fold: the state machine applied event by event."""
    st = {"generating": False, "cands": [], "error": None, "success": None}
    for i, (t, cid, msg, count, payload) in enumerate(evs):
        if t == C.SET_LOADING:
            st.update(generating=True, cands=[], error=None, success=None)
        elif t == C.ADD:
            st["cands"] = st["cands"] + [{"id": cid, "message": msg, "reason": f"why {i}", "files": [f"f{i}"],
                                            "checked": True}]
        elif t == C.DONE:
            st["generating"] = False
        elif t == C.ERROR:
            st.update(generating=False, error=msg)
        elif t == C.COMMITTED:
            st.update(cands=[], success=count)
        elif t == C.TOGGLE:
            st["cands"] = [dict(c, checked=not c["checked"]) if c["id"] == cid else c for c in st["cands"]]
        elif t == C.UPDATE_MESSAGE:
            st["cands"] = [dict(c, message=msg) if c["id"] == cid else c for c in st["cands"]]
        elif t == C.REORDER:
            st["cands"] = [dict(id=p[0], message=p[1], reason=f"moved {i}", files=[f"g{i}"], checked=p[2]) for p in payload]
    return st


def _fold_spark(spark, evs):
    ev = _events(spark, evs)
    status = C.session_status(ev).first()
    entries = C.list_positions(C.fold_candidates(ev)).orderBy("list_pos").collect()
    return {"generating": status.generating, "error": status.error, "success": status.success_count,
            "cands": [_candidate(e) for e in entries]}


def _candidate(e):
    return {"id": e.id, "message": e.message, "reason": e.reason, "files": e.files, "checked": e.checked}


def test_fold_edge_cases(spark):
    evs = [(C.TOGGLE, "a", None, None, None), (C.ADD, "a", "m", None, None), (C.TOGGLE, "a", None, None, None),
           (C.TOGGLE, "a", None, None, None), (C.ADD, "a", "dup", None, None), (C.TOGGLE, "a", None, None, None)]
    got = _fold_spark(spark, evs)
    assert got["cands"] == [
        {"id": "a", "message": "m", "reason": "why 1", "files": ["f1"], "checked": False},
        {"id": "a", "message": "dup", "reason": "why 4", "files": ["f4"], "checked": False}]
    evs2 = [(C.ADD, "a", "m", None, None), (C.UPDATE_MESSAGE, "a", "e", None, None),
            (C.SET_LOADING, None, None, None, None)]
    assert _fold_spark(spark, evs2)["cands"] == []


def test_fold_matches_reference_on_random_logs(spark):
    rnd = random.Random(7)
    types = [C.ADD, C.ADD, C.TOGGLE, C.UPDATE_MESSAGE, C.SET_LOADING, C.DONE, C.ERROR, C.COMMITTED, C.REORDER]
    for trial in range(12):
        evs = []
        for _ in range(rnd.randint(1, 25)):
            t = rnd.choice(types)
            cid = rnd.choice(["a", "b", "c"])
            payload = [(rnd.choice("abc"), f"p{trial}", rnd.random() < 0.5) for _ in range(rnd.randint(0, 3))]
            evs.append((t, cid if t in (C.ADD, C.TOGGLE, C.UPDATE_MESSAGE) else None,
                        f"m{len(evs)}" if t in (C.ADD, C.UPDATE_MESSAGE, C.ERROR) else None,
                        rnd.randint(1, 3) if t == C.COMMITTED else None,
                        payload if t == C.REORDER else None))
        assert _fold_spark(spark, evs) == _fold_py(evs), evs


def _items(spark, n):
    return spark.createDataFrame([(1, p, f"c{p}") for p in range(n)], "session long, list_pos int, candidate_id string")


def test_reorder_example_and_inverse(spark):
    moves = spark.createDataFrame([(1, 0, 2)], "session long, from_idx int, to_idx int")
    got = C.reorder(_items(spark, 4), moves).orderBy("list_pos").collect()
    assert [r.candidate_id for r in got] == ["c0", "c3", "c1", "c2"]
    back = spark.createDataFrame([(1, 2, 0)], "session long, from_idx int, to_idx int")
    again = C.reorder(C.reorder(_items(spark, 4), moves), back).orderBy("list_pos").collect()
    assert [r.candidate_id for r in again] == ["c0", "c1", "c2", "c3"]
    bad = spark.createDataFrame([(1, 0, 9)], "session long, from_idx int, to_idx int")
    assert [r.candidate_id for r in C.reorder(_items(spark, 4), bad).orderBy("list_pos").collect()] == \
        ["c0", "c1", "c2", "c3"]


def test_edits_trim_ignore_blank_latest(spark):
    items = spark.createDataFrame([(1, "a", "old"), (1, "b", "keep")], "session long, id string, message string")
    edits = spark.createDataFrame([(1, "a", 1, "  new "), (1, "a", 2, "   "), (1, "b", 1, " ")],
                                  "session long, id string, seq long, message string")
    got = {r.id: r.message for r in C.apply_edits(items, edits, ["session", "id"]).collect()}
    assert got == {"a": "new", "b": "keep"}


def _host(spark):
    return spark.createDataFrame([(1, p, f"c{p}", f"m{p}", [f"f{p}"]) for p in range(3)],
                                 "session long, list_pos int, candidate_id string, message string, files array<string>")


def test_selected_order_and_unknown_ids(spark):
    host = _host(spark)
    sel = spark.createDataFrame([(1, "c2"), (1, "c0"), (1, "zz")], "session long, candidate_id string")
    got = [r.candidate_id for r in C.selected(host, sel, None, ["session"]).orderBy("list_pos").collect()]
    assert got == ["c0", "c2"]
    left = C.unselected_files(host, sel, ["session"]).collect()
    assert [r.path for r in left] == ["f1"]
    plan = commit_plan(C.selected(host, sel, None, ["session"]), C.unselected_files(host, sel, ["session"]),
                       ["session"]).orderBy("step").collect()
    assert [(r.step, r.action) for r in plan] == [(0, "unstage_all"), (1, "stage"), (2, "commit"),
                                                   (3, "stage"), (4, "commit"), (5, "restage")]
    none = spark.createDataFrame([], "session long, candidate_id string")
    assert commit_plan(C.selected(host, none, None, ["session"]), C.unselected_files(host, none, ["session"]),
                       ["session"]).count() == 0


def test_latest_generation_cancel(spark):
    cands = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("s", 5, "c")],
                                  "repo string, generation long, candidate_id string")
    runs = spark.createDataFrame([("r", 1, False), ("r", 2, False), ("s", 5, False), ("s", 6, True)],
                                 "repo string, generation long, cancelled boolean")
    got = [r.candidate_id for r in C.latest_generation(cands, runs).collect()]
    assert got == ["b"]


def test_fold_across_many_buckets_matches_reference(spark):
    rnd = random.Random(11)
    types = [C.ADD, C.ADD, C.ADD, C.TOGGLE, C.TOGGLE, C.UPDATE_MESSAGE, C.DONE, C.ERROR, C.REORDER, C.SET_LOADING]
    evs = []
    for _ in range(400):
        t = rnd.choices(types, weights=[6, 6, 6, 8, 8, 5, 2, 1, 1, 1])[0]
        cid = rnd.choice(["a", "b", "c", "d"])
        payload = [(rnd.choice("abcd"), "p", rnd.random() < 0.5) for _ in range(rnd.randint(0, 3))]
        evs.append((t, cid if t in (C.ADD, C.TOGGLE, C.UPDATE_MESSAGE) else None,
                    f"m{len(evs)}" if t in (C.ADD, C.UPDATE_MESSAGE, C.ERROR) else None,
                    None, payload if t == C.REORDER else None))
    ev = _events(spark, evs)
    entries = C.list_positions(C.fold_candidates(ev, width=5), width=3).orderBy("list_pos").collect()
    assert [_candidate(e) for e in entries] == _fold_py(evs)["cands"]


def test_panel_state_takes_the_last_of_each(spark):
    none = dict.fromkeys(["id", "message", "reason", "files", "count", "payload", "settings", "key", "value", "models",
                          "history"])
    evs = [dict(type=C.SET_SETTINGS, settings=(False, "zh")), dict(type=C.UPDATE_SETTING, key="language", value="fr"),
           dict(type=C.SET_STAGED_FILES, files=["a"]), dict(type=C.SET_STAGED_FILES, files=["b", "c"]),
           dict(type=C.SET_MODELS, models=[("m", "M")]), dict(type=C.SET_PROMPT, message="p"),
           dict(type=C.SET_COMMIT_HISTORY, history=["h"]), dict(type=C.ADD, id="x", message="not a prompt"),
           dict(type=C.UPDATE_SETTING, key="conventionalCommits", value="true")]
    fields = [f.split()[0] for f in ("session seq type id message reason files count payload settings key value models "
                                     "history").split()]
    rows = [tuple({**none, **e, "session": 1, "seq": i}[f] for f in fields) for i, e in enumerate(evs)]
    rows.append(tuple({**none, "type": C.DONE, "session": 2, "seq": 0}[f] for f in fields))
    got = {r.session: r for r in C.panel_state(spark.createDataFrame(rows, C.EVENT_SCHEMA)).collect()}
    a = got[1]
    assert (a.staged_files, [tuple(m) for m in a.models], a.prompt, a.history, a.conventional, a.language) == (
        ["b", "c"], [("m", "M")], "p", ["h"], True, "fr")
    assert tuple(got[2])[1:] == ([], [], "", [], True, "en")


def test_reorder_applies_moves_in_turn(spark):
    rnd = random.Random(3)
    for _ in range(4):
        n = rnd.randint(1, 6)
        drags = [(rnd.randint(-1, n), rnd.randint(-1, n)) for _ in range(rnd.randint(1, 5))]
        moves = spark.createDataFrame([(1, s, i, j) for s, (i, j) in enumerate(drags)],
                                      "session long, seq int, from_idx int, to_idx int")
        shown = [f"c{p}" for p in range(n)][::-1]
        for i, j in drags:
            if 0 <= i < n and 0 <= j < n:
                shown.insert(j, shown.pop(i))
        got = C.reorder(_items(spark, n), moves).orderBy("list_pos").collect()
        assert [r.candidate_id for r in got] == shown[::-1]


def _replayed(n, drags):
    shown = [f"c{p}" for p in range(n)][::-1]
    for i, j in drags:
        if 0 <= i < n and 0 <= j < n:
            shown.insert(j, shown.pop(i))
    return shown[::-1]


def test_drags_compose_in_any_grouping():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(2, 9)
        moves = [tuple(rnd.sample(range(n), 2)) for _ in range(rnd.randint(1, 9))]
        items = list(range(n))
        for i, j in moves:
            items.insert(j, items.pop(i))
        maps = [drags.drag(i, j, n) for i, j in moves]
        cut = rnd.randint(0, len(maps) - 1)
        parts = [drags.merged(m) for m in (maps[:cut], maps[cut:]) if m]
        for starts, shifts in (drags.merged(maps), drags.merged(parts)):
            at = [p + int(shifts[starts.searchsorted(p, "right") - 1]) for p in range(n)]
            assert [items[q] for q in at] == list(range(n))
            assert len(starts) <= min(n, 3 * len(moves) + 1)


def test_reorder_with_a_long_history_of_drags(spark):
    rnd = random.Random(9)
    n, m = 3_000, 100_000
    moved = [(rnd.randint(0, n - 1), rnd.randint(0, n - 1)) for _ in range(m)]
    lists = spark.range(n).selectExpr("1L AS session", "CAST(id AS INT) AS list_pos", "concat('c', id) AS candidate_id")
    other = lists.selectExpr("2L AS session", "list_pos", "candidate_id")
    moves = spark.createDataFrame(pd.DataFrame(
        [(1, s, i, j) for s, (i, j) in enumerate(moved)], columns=["session", "seq", "from_idx", "to_idx"]))
    # Ranges of positions and drags end within the lists.
    out = C.reorder(lists.unionByName(other), moves, width=700)
    got = out.orderBy("session", "list_pos").toPandas()
    assert got[got.session == 1].candidate_id.tolist() == _replayed(n, moved)
    assert got[got.session == 2].candidate_id.tolist() == [f"c{p}" for p in range(n)]
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_reorder_odd_rows(spark):
    items = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None), (1, None, "c", "x"), (None, 0, "d", "x"), (2, 0, "e", "y")],
                                  "session long, list_pos int, candidate_id string, seq string")
    schema = "session long, seq long, from_idx int, to_idx int"
    moves = spark.createDataFrame([(1, None, 1, 2), (1, 4, None, 1), (3, 1, 0, 1), (None, 1, 0, 1), (1, 5, 0, 7)], schema)
    got = {(r.session, r.candidate_id): r.list_pos for r in C.reorder(items, moves).collect()}
    # Three rows: shown 1 -> 2 is list position 1 -> 0.
    assert got == {(1, "a"): 1, (1, "b"): 0, (1, "c"): None, (None, "d"): 0, (2, "e"): 0}
    assert C.reorder(items, moves).columns == items.columns
    assert C.reorder(items.limit(0), moves).count() == 0
    assert sorted(C.reorder(items, moves.limit(0)).collect(), key=str) == sorted(items.collect(), key=str)
