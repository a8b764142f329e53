"""Candidate-state jobs: fold UI events into state (OP-30), newest
generation wins (OP-31), reorder (OP-32), message edits (OP-33), selected and
unselected candidates (OP-34/35).

The fold is set-based, never a per-session collect: a session may hold a
third of all events, so every step is an aggregate that combines map-side,
a join against one row per session (AQE splits a skewed side), or a window
keyed by (session, candidate id) that is linear in its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import is_blank, js_trim
from ..functions.scans import DEFAULT_WIDTH, after_sum_and_max, running_count
from .drags import composed

# The event (action) types of the UI state machine.
SET_LOADING = "SET_LOADING"
ADD = "ADD_CANDIDATE"
DONE = "DONE"
ERROR = "ERROR"
COMMITTED = "COMMITTED"
TOGGLE = "TOGGLE_CANDIDATE"
UPDATE_MESSAGE = "UPDATE_CANDIDATE_MESSAGE"
REORDER = "REORDER_CANDIDATES"
SET_STAGED_FILES = "SET_STAGED_FILES"
SET_SETTINGS = "SET_SETTINGS"
SET_MODELS = "SET_MODELS"
SET_PROMPT = "SET_PROMPT"
UPDATE_SETTING = "UPDATE_SETTING"
SET_COMMIT_HISTORY = "SET_COMMIT_HISTORY"
LIST_RESETS = [SET_LOADING, COMMITTED, REORDER]

EVENT_SCHEMA = ("session BIGINT, seq BIGINT, type STRING, id STRING, message STRING, reason STRING, "
                "files ARRAY<STRING>, count INT, payload ARRAY<STRUCT<id: STRING, message: STRING, reason: STRING, "
                "files: ARRAY<STRING>, checked: BOOLEAN>>, settings STRUCT<conventional: BOOLEAN, language: STRING>, "
                "key STRING, value STRING, models ARRAY<STRUCT<id: STRING, name: STRING>>, history ARRAY<STRING>")
# The settings' names in UPDATE_SETTING and their first values.
SETTING_CONVENTIONAL, SETTING_LANGUAGE = "conventionalCommits", "language"
FIRST_CONVENTIONAL, FIRST_LANGUAGE = True, "en"


def _last_of(types: list[str], value, seq: str = "seq"):
    """Value of the latest event among ``types`` (NULL when none): ``max_by``
    skips rows whose ordering is NULL, and combines map-side."""
    return F.max_by(value, F.when(F.col("type").isin(types), F.col(seq)))


def session_status(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """OP-30 scalar state per session: generating, error, success count,
    staged-files state, and the seq of the last list reset (``base_seq``).

    ``prior`` (the same columns, from older events) is merged: a field keeps
    its prior value unless the new events hold an event that sets it."""
    t = F.col("type")
    new = events.groupBy("session").agg(
        _last_of([SET_LOADING, DONE, ERROR], t == SET_LOADING).alias("generating"),
        _last_of([SET_LOADING, ERROR], F.when(t == ERROR, F.col("message"))).alias("error"),
        _last_of([SET_LOADING, COMMITTED], F.when(t == COMMITTED, F.col("count"))).alias("success_count"),
        F.max(F.when(t == SET_STAGED_FILES, F.lit(True))).isNull().alias("staged_loading"),
        F.max(F.when(t.isin(LIST_RESETS), F.col("seq"))).alias("base_seq"),
        F.max(F.when(t.isin(SET_LOADING, DONE, ERROR), F.lit(True))).alias("_has_gen"),
        F.max(F.when(t.isin(SET_LOADING, ERROR), F.lit(True))).alias("_has_err"),
        F.max(F.when(t.isin(SET_LOADING, COMMITTED), F.lit(True))).alias("_has_ok"),
    )
    if prior is None:
        return new.select("session", F.coalesce("generating", F.lit(False)).alias("generating"), "error",
                          "success_count", "staged_loading", "base_seq")
    p = prior.select("session", *[F.col(c).alias("_p_" + c) for c in
                                  ("generating", "error", "success_count", "staged_loading", "base_seq")])
    m = new.join(p, "session", "left")

    def pick(flag: str, col: str):
        return F.when(F.col(flag).isNotNull(), F.col(col)).otherwise(F.col("_p_" + col))
    return m.select(
        "session",
        F.coalesce(pick("_has_gen", "generating"), F.lit(False)).alias("generating"),
        pick("_has_err", "error").alias("error"),
        pick("_has_ok", "success_count").alias("success_count"),
        (F.coalesce(F.col("_p_staged_loading"), F.lit(True)) & F.col("staged_loading")).alias("staged_loading"),
        F.coalesce(F.col("base_seq"), F.col("_p_base_seq")).alias("base_seq"),
    )


def panel_state(events: DataFrame) -> DataFrame:
    """OP-30, everything but the candidate list and the status: per session
    the staged files, models, prompt, commit history and settings, each from
    the last event that sets it (SET_SETTINGS sets both settings,
    UPDATE_SETTING the one it names).  All aggregates combine map-side."""
    t = F.col("type")

    def setting(name: str, whole, one):
        sets = (t == SET_SETTINGS) | ((t == UPDATE_SETTING) & (F.col("key") == name))
        return F.max_by(F.when(t == SET_SETTINGS, whole).otherwise(one), F.when(sets, F.col("seq")))
    nothing = F.array().cast("array<string>")
    out = events.groupBy("session").agg(
        _last_of([SET_STAGED_FILES], F.col("files")).alias("staged_files"),
        _last_of([SET_MODELS], F.col("models")).alias("models"),
        _last_of([SET_PROMPT], F.col("message")).alias("prompt"),
        _last_of([SET_COMMIT_HISTORY], F.col("history")).alias("history"),
        setting(SETTING_CONVENTIONAL, F.col("settings.conventional"), F.col("value") == "true").alias("conventional"),
        setting(SETTING_LANGUAGE, F.col("settings.language"), F.col("value")).alias("language"))
    return out.select(
        "session", F.coalesce("staged_files", nothing).alias("staged_files"),
        F.coalesce("models", F.array().cast("array<struct<id:string,name:string>>")).alias("models"),
        F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("history", nothing).alias("history"),
        F.coalesce("conventional", F.lit(FIRST_CONVENTIONAL)).alias("conventional"),
        F.coalesce("language", F.lit(FIRST_LANGUAGE)).alias("language"))


def fold_candidates(events: DataFrame, status: DataFrame | None = None,
                    prior: DataFrame | None = None, width: int = DEFAULT_WIDTH) -> DataFrame:
    """OP-30 candidate list per session, in list order.

    * the list restarts at the last SET_LOADING / COMMITTED / REORDER
      (``base_seq``); a REORDER there contributes its payload;
    * every ADD after it appends one entry (duplicate ids are separate
      entries: entries are keyed by (seq, sub-position), not by id);
    * a TOGGLE / UPDATE_MESSAGE at seq t touches every entry with that id
      that exists at t, i.e. entered before t.

    Per entry: the number of toggles and the latest edit after it come from
    one bucketed scan from the end (both merge associatively), so one hot
    (session, id) is spread over several tasks.

    ``prior`` (the columns of the output) is the list
    as it stood before ``events`` (all its seqs are older): it is kept for
    sessions whose new events hold no list reset, and new toggles and edits
    apply to it.  This makes the fold incremental for streams.
    Output: session, entry_seq, sub_pos, id, message, reason, files, checked.
    """
    status = status if status is not None else session_status(events)
    base = status.select("session", "base_seq")
    ev = events.join(base, "session", "left")
    after = F.col("seq") > F.coalesce(F.col("base_seq"), F.lit(-1))
    t = F.col("type")
    keys = ["session", "id"]

    def entry(sub_pos, id_, message, reason, files, checked):
        return F.struct(sub_pos.cast("int").alias("sub_pos"), id_.alias("id"), message.alias("m0"), reason.alias("reason"),
                        files.alias("files"), checked.alias("c0"))
    touch = t.isin(TOGGLE, UPDATE_MESSAGE)
    of_event = entry(F.lit(0), F.col("id"), F.when(t == ADD, F.col("message")), F.when(t == ADD, F.col("reason")),
                     F.when(t == ADD, F.col("files")), t == ADD)
    of_list = F.transform("payload", lambda p, i: entry(i, p["id"], p["message"], p["reason"], p["files"],
                                                        F.coalesce(p["checked"], F.lit(False))))
    # One branch for all: events are read and joined once.
    rows = (ev.filter((t.isin(ADD, TOGGLE, UPDATE_MESSAGE) & after) | ((t == REORDER) & (F.col("seq") == F.col("base_seq"))))
            .select("session", F.col("seq").alias("entry_seq"), touch.cast("int").alias("_touch"),
                    (t == TOGGLE).cast("long").alias("_toggles"),
                    F.when(t == UPDATE_MESSAGE, F.struct(F.col("seq").alias("_s"), F.col("message").alias("_m"))).alias("_edit"),
                    F.explode_outer(F.when(t == REORDER, of_list).otherwise(F.array(of_event))).alias("_e"))
            .filter(F.col("_e.sub_pos").isNotNull())
            .select("session", "entry_seq", "_e.*", "_touch", "_toggles", "_edit"))
    if prior is not None:
        no_reset = base.filter(F.col("base_seq").isNull()).select("session")
        rows = rows.unionByName(prior.join(no_reset, "session", "left_semi").select(
            "session", "entry_seq", "sub_pos", "id", F.col("message").alias("m0"), "reason", "files",
            F.col("checked").alias("c0"), F.lit(0).alias("_touch"), F.lit(0).cast("long").alias("_toggles"),
            F.lit(None).cast("struct<_s: bigint, _m: string>").alias("_edit")))
    touched = after_sum_and_max(rows, keys, ["entry_seq", "_touch", "sub_pos"], "_toggles", "_edit", width)
    message = F.when(F.col("_edit._s") > F.col("entry_seq"), F.col("_edit._m")).otherwise(F.col("m0"))
    return touched.filter(F.col("_touch") == 0).select(
        "session", "entry_seq", "sub_pos", "id", message.alias("message"), "reason", "files",
        (F.col("c0") != (F.col("_toggles") % 2 == 1)).alias("checked"))


def list_positions(entries: DataFrame, key: str = "session", width: int = DEFAULT_WIDTH) -> DataFrame:
    """0-based list position of every entry (order: entry_seq, sub_pos),
    by a bucketed running count."""
    return running_count(entries, [key], ["entry_seq", "sub_pos"], "list_pos", width=width).withColumn(
        "list_pos", F.col("list_pos").cast("int"))


def selection_counts(entries: DataFrame, keys: list[str], checked_col: str = "checked") -> DataFrame:
    """OP-37: total, checked and unchecked candidates per key, and whether any
    exists.  ``count_if`` combines map-side."""
    c = F.col(checked_col)
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c).alias("checked"),
        F.count_if(~c).alias("unchecked"),
    ).withColumn("has_any", F.col("total") > 0)


# ---------------------------------------------------------------------------
# OP-31
# ---------------------------------------------------------------------------

def latest_generation(cands: DataFrame, runs: DataFrame, session: str = "repo",
                      generation: str = "generation") -> DataFrame:
    """Keep the candidates of each session's newest run, unless that run was
    cancelled (a restart clears earlier candidates, so nothing older
    survives).  One aggregate row per session joins back."""
    newest = (runs.groupBy(session)
              .agg(F.max_by(F.struct(F.col(generation).alias("_g"), F.col("cancelled").alias("_c")),
                            F.col(generation)).alias("_n")))
    keep = newest.filter(~F.coalesce(F.col("_n._c"), F.lit(False))).select(
        session, F.col("_n._g").alias(generation))
    return cands.join(keep, [session, generation], "left_semi")


# ---------------------------------------------------------------------------
# OP-32
# ---------------------------------------------------------------------------

def reorder(items: DataFrame, moves: DataFrame, key: str = "session",
            pos_col: str = "list_pos", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Apply each key's drags in order of ``seq`` (one drag per key needs no
    ``seq``): move *display* index i to j, where the list is shown newest
    first (display d = n - 1 - list position).

    The moved item goes to j, items between shift by one toward the gap,
    others stay.  i == j or an index outside 0..n-1 leaves the list unchanged.
    Returns items with a new ``pos_col``.

    A key's drags are composed into shifts of index ranges (``drags``); each
    item then takes the shift of its range, found by a window over ``width``
    list positions, so neither long lists nor long histories of drags meet an
    item one by one.
    """
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    seq = F.coalesce(F.col("seq"), F.lit(-1)) if "seq" in moves.columns else F.lit(0)
    # A drag from i to j is one from n-1-i to n-1-j by list position.
    drags = (moves.select(F.col(key).alias("key"), seq.cast("long").alias("seq"),
                          F.col("from_idx").cast("long").alias("f"), F.col("to_idx").cast("long").alias("t"))
             .join(n.withColumnRenamed(key, "key"), "key")
             .filter((F.col("f") != F.col("t")) & (F.col("f") >= 0) & (F.col("t") >= 0)
                     & (F.col("f") < F.col("n")) & (F.col("t") < F.col("n")))
             .select("key", "n", "seq", (F.col("n") - 1 - F.col("f")).alias("i"), (F.col("n") - 1 - F.col("t")).alias("j")))
    block = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    shifts = (composed(drags).withColumn("_block", block)
              .select(F.col("key").alias(key), "_block", F.greatest("start", F.col("_block") * width).alias("_at"),
                      F.struct("end", "shift").alias("_shift")))
    at = F.col(pos_col).cast("long")
    rows = items.withColumns({"_block": F.floor(at / width), "_at": at, "_shift": F.lit(None), "_item": F.lit(True)})
    upto = (Window.partitionBy(key, "_block").orderBy("_at", F.col("_item").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    found = (rows.withColumn("_shift", F.col("_shift").cast("struct<end: bigint, shift: bigint>"))
             .unionByName(shifts, allowMissingColumns=True)
             .withColumn("_shift", F.last("_shift", ignorenulls=True).over(upto)).filter("_item"))
    moved = F.when(at < F.col("_shift.end"), at + F.col("_shift.shift")).otherwise(at)
    return found.withColumn(pos_col, moved.cast("int")).drop("_block", "_at", "_shift", "_item")


# ---------------------------------------------------------------------------
# OP-33
# ---------------------------------------------------------------------------

def apply_edits(items: DataFrame, edits: DataFrame, keys: list[str],
                message_col: str = "message") -> DataFrame:
    """Saved edits: trimmed, blank ones ignored, the latest per candidate
    wins; items without a valid edit keep their message."""
    valid = edits.filter(~is_blank("message")).select(*keys, "seq", js_trim("message").alias("_m"))
    latest = valid.groupBy(*keys).agg(F.max_by("_m", "seq").alias("_edit"))
    return (items.join(latest, keys, "left")
            .withColumn(message_col, F.coalesce("_edit", message_col)).drop("_edit"))


# ---------------------------------------------------------------------------
# OP-34 / OP-35
# ---------------------------------------------------------------------------

def selected(host: DataFrame, selection: DataFrame, client: DataFrame | None,
             keys: list[str], order_col: str = "list_pos") -> DataFrame:
    """OP-34: selected candidates in execution order.

    Taken from the client's ordered list (which carries reorders and edits)
    for keys that sent one, else from the host list; ids not in the list are
    ignored; order is list order, not selection order."""
    sel = selection.select(*keys, "candidate_id").distinct()
    host_rows = host.select(*keys, "candidate_id", "message", "files", order_col)
    if client is None:
        chosen = host_rows
    else:
        client_rows = client.select(*keys, "candidate_id", "message", "files", order_col)
        has_client = client_rows.select(*keys).distinct()
        chosen = client_rows.unionByName(host_rows.join(has_client, keys, "left_anti"))
    return chosen.join(sel, keys + ["candidate_id"], "left_semi")


def unselected_files(host: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """OP-35: files of the host's candidates that are not selected, one row
    per file, in list order."""
    sel = selection.select(*keys, "candidate_id").distinct()
    rest = host.join(sel, keys + ["candidate_id"], "left_anti")
    return (rest.select(*keys, "candidate_id", "list_pos", F.posexplode_outer("files").alias("file_pos", "path"))
            .filter(F.col("file_pos").isNotNull()))
