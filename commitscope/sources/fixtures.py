"""Corpora derived from the driver's tables.

The driver ships generic tables (documents, events, conversations, ...).  The
jobs here turn them into the inputs of the commit-corpus operators with
Spark expressions only, so the derived corpora grow with the tables.  Every
recipe has a twin in :mod:`commitscope.sources.fixture_sql` that produces the
same bytes in DuckDB; the SQL oracle starts from that twin.

Recipes (all keyed by columns of the source rows, never by row order):

* commits   - one document is one file diff, eight consecutive documents
  (``doc_id div 8``) are one staged snapshot; ``repo = 'repo-' || commit_id % 10``.
* commit_log / users - one document is one log entry of repo ``doc_id % 4``;
  its whole text (newlines as spaces) is the subject.
* responses - one conversation turn is one model answer of seven shapes.
* response_chunks - each answer cut into 7-character pieces.
* candidate_events - one event row is one UI action of session ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TABLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The DataFrame is reused within a session (the
    tables are read-only), so a query reading a table twice lists the file
    and reads its footer once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


# Fixed values of the recipe: the file path of document ``doc_id`` is entry
# ``doc_id % 12`` of this list with ``#`` replaced by the doc_id.
FIXTURE_PATHS = [
    "package.json", "src/app/m#.ts", "lib/core#.py", "tests/t#.py", "README.md",
    "tsconfig.json", "docs/guide#.html", "main#.go", "src/x#.test.ts", ".env.local",
    "infra/ci#.yaml", "poetry.lock",
]
JUNK_PREFIX = "warning: LF will be replaced by CRLF in staged files\n"
BLANK_DIFF = " \t\n"
BLANK_ID_BASE = 10**15
REFUSAL = "the model refused this prompt"


def _pick(values: list[str], index_col) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index_col + 1).cast("int"))


def diff_segment(doc: F.Column, text: F.Column) -> F.Column:
    """The unified-diff segment of one document (an in-row expression)."""
    path = F.replace(_pick(FIXTURE_PATHS, doc % 12), F.lit("#"), doc.cast("string"))
    kind = doc % 7
    a_path = F.when(kind == 2, F.concat(F.lit("old/"), path)).otherwise(path)
    type_lines = (
        F.when(kind == 0, F.lit("new file mode 100644\n"))
        .when(kind == 1, F.lit("deleted file mode 100644\n"))
        .when(kind == 2, F.concat(F.lit("similarity index 90%\nrename from "), a_path,
                                  F.lit("\nrename to "), path, F.lit("\n")))
        .otherwise(F.lit(""))
    )
    lines = F.split(text, "\n", -1)
    n = F.size(lines).cast("string")
    body = F.array_join(
        F.transform(lines, lambda x, i: F.concat(_pick([" ", "+", "-"], (doc + i) % 3), x)), "\n")
    return F.concat(
        F.lit("diff --git a/"), a_path, F.lit(" b/"), path, F.lit("\n"), type_lines,
        F.lit("index 1111111..2222222\n--- a/"), a_path, F.lit("\n+++ b/"), path,
        F.lit("\n@@ -"), (doc % 50 + 1).cast("string"), F.lit(","), n,
        F.lit(" +"), (doc % 40 + 1).cast("string"), F.lit(","), n, F.lit(" @@\n"),
        body, F.lit("\n"))


def file_diff_segments(documents: DataFrame) -> DataFrame:
    """One unified-diff segment per document (narrow: no shuffle)."""
    doc = F.col("doc_id")
    return documents.select(doc, F.expr("doc_id div 8").alias("commit_id"),
                            diff_segment(doc, F.col("text")).alias("seg"))


def commits_from_documents(documents: DataFrame, nation: DataFrame) -> DataFrame:
    """``commits(repo, commit_id, raw_diff)``: one row per staged snapshot.

    Groups hold exactly eight documents, so the ordered collect is bounded.
    The raw documents are shuffled to their snapshot and the segments are
    built after the shuffle, so that work runs on every reduce partition
    even when the table arrives as one file.  Every 5th snapshot has text
    before its first header (skipped by the parser).  Each nation adds a
    blank snapshot (reported as ``no_changes``) of a repo of its own.
    """
    docs = documents.select("doc_id", "text", F.expr("doc_id div 8").alias("commit_id"))
    snap = docs.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("_docs"))
    body = F.array_join(F.transform("_docs", lambda d: diff_segment(d["doc_id"], d["text"])), "")
    cid = F.col("commit_id")
    raw = F.when(cid % 5 == 4, F.concat(F.lit(JUNK_PREFIX), body)).otherwise(body)
    full = snap.select(F.concat(F.lit("repo-"), (cid % 10).cast("string")).alias("repo"),
                       cid.alias("commit_id"), raw.alias("raw_diff"))
    key = F.col("n_nationkey")
    blank = nation.select(F.concat(F.lit("blank-"), (key % 10).cast("string")).alias("repo"),
                          (F.lit(BLANK_ID_BASE) + key).cast("long").alias("commit_id"),
                          F.lit(BLANK_DIFF).alias("raw_diff"))
    return full.unionByName(blank)


def load_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits_from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "nation"))


# ---------------------------------------------------------------------------
# commit_log and users
# ---------------------------------------------------------------------------

# Fixed values of the recipe: the e-mail local part of each repo's current user.
FIXTURE_USERS = [("repo-0", "en"), ("repo-1", "FR"), ("repo-2", "es"), ("repo-3", "none")]
FIXTURE_DATE = "2024-03-05 14:07:33 +0100"
CJK = "中"
LOG_POS_BASE = 10**12


def commit_log_from_documents(documents: DataFrame) -> DataFrame:
    """``commit_log``: one document is one log entry; newest = highest doc_id.

    ``log_pos`` is the git-log sort key inside a repo: smaller is newer, gaps
    are allowed.  It is computed per row (``LOG_POS_BASE - doc_id``), so the
    derivation needs no window over a possibly huge repo.
    """
    doc = F.col("doc_id")
    subject = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    subject = F.when(F.col("lang") == "es", F.translate(subject, "aeiou", CJK * 5)).otherwise(subject)
    email_local = F.when(doc % 3 == 0, F.upper(F.col("lang"))).otherwise(F.col("lang"))
    return documents.select(
        F.concat(F.lit("repo-"), (doc % 4).cast("string")).alias("repo"),
        doc,
        F.md5(doc.cast("string")).alias("hash"),
        subject.alias("subject"),
        F.concat(F.lit("Author "), F.col("source")).alias("author"),
        F.concat(email_local, F.lit("@example.org")).alias("email"),
        F.lit(FIXTURE_DATE).alias("date"),
        (doc % 11 == 0).alias("is_merge"),
        (F.lit(LOG_POS_BASE) - doc).cast("long").alias("log_pos"),
    ).drop("doc_id")


def users_table(spark: SparkSession) -> DataFrame:
    """The current user per repo: a four-row parameter table of the recipe."""
    rows = [(repo, f"  {local}@Example.org ") for repo, local in FIXTURE_USERS]
    return spark.createDataFrame(rows, "repo string, email string")


def load_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_log_from_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------------
# Options: requests per snapshot and partial updates of stored options
# ---------------------------------------------------------------------------

# Fixed values of the recipe: request language by ``commit_id % 7`` and model
# by ``commit_id % 3`` (NULL model when ``commit_id % 4 = 0``).
REQUEST_LANGUAGES = ["en", "zh", "auto", "fr", "auto", "", "zh"]
REQUEST_MODELS = ["model-3", "model-7", "missing-model"]
REQUEST_PROMPT = "Mention the ticket number."


def requests_from_commits(commits: DataFrame) -> DataFrame:
    """One generation request per snapshot of a repo, ``seq = commit_id``.

    Every fifth request is a plain reload (``ready``, no options)."""
    cid = F.col("commit_id")
    regen = cid % 5 != 0
    return commits.select(
        "repo", "commit_id", cid.alias("seq"),
        F.when(regen, F.lit("regenerate")).otherwise(F.lit("ready")).alias("kind"),
        F.when(regen, cid % 3 != 0).alias("conventional"),
        F.when(regen, _pick(REQUEST_LANGUAGES, cid % 7)).alias("language"),
        F.when(regen & (cid % 4 != 0), _pick(REQUEST_MODELS, cid % 3)).alias("model"),
        F.when(regen & (cid % 6 == 1), F.lit(REQUEST_PROMPT)).alias("prompt"),
    )


def option_updates_from_nation(nation: DataFrame) -> DataFrame:
    """Partial updates of stored options: one per nation row (NULL = unchanged)."""
    k = F.col("n_nationkey")
    return nation.select(
        F.concat(F.lit("repo-"), (k % 10).cast("string")).alias("repo"),
        k.cast("long").alias("seq"),
        F.when(k % 3 != 0, F.col("n_regionkey") % 2 == 0).alias("conventional"),
        F.when(k % 4 == 0, F.lit("zh")).when(k % 4 == 2, F.lit("en"))
        .when(k % 4 == 3, F.lit("auto")).alias("language"),
    )


# ---------------------------------------------------------------------------
# Model catalogues from supplier x nation
# ---------------------------------------------------------------------------

# Fixed values of the recipe: vendors and families by supplier key.
MODEL_VENDORS = ["copilot", "openai", "anthropic"]
MODEL_FAMILIES = ["gpt-4o", "gpt-4.1", "claude", "gemini"]


def models_from_suppliers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """``models(catalog_id, id, name, vendor, family, cat_pos)``.

    Catalogue r = suppliers of region r.  Region 1 lacks the preferred family
    and region 2 the preferred vendor; requests may also name a catalogue
    that no supplier is in: every fallback tier and the error case occur."""
    s = supplier.join(nation.select("n_nationkey", "n_regionkey"),
                      supplier["s_nationkey"] == nation["n_nationkey"])
    k, r = F.col("s_suppkey"), F.col("n_regionkey")
    vendor = F.when(r == 2, _pick(MODEL_VENDORS[1:], k % 2)).otherwise(_pick(MODEL_VENDORS, k % 3))
    family = F.when(r == 1, _pick(MODEL_FAMILIES[1:3], k % 2)).otherwise(_pick(MODEL_FAMILIES, k % 4))
    return s.select(
        r.cast("int").alias("catalog_id"),
        F.concat(F.lit("model-"), k.cast("string")).alias("id"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("s_name")).alias("name"),
        vendor.alias("vendor"), family.alias("family"), k.cast("int").alias("cat_pos"))


# ---------------------------------------------------------------------------
# A deterministic stand-in for a model (tests and registered queries)
# ---------------------------------------------------------------------------

def echo_model(batches):
    """Answer every prompt with a JSON array holding one item per group it
    lists.  A pure function of the prompt text (re-runs and retried tasks
    give the same answers); by prompt length it also answers in a code
    fence, between chatter lines, or with one item too few, so the parser's
    paths all occur, and it fails on some prompts."""
    import json
    import re

    import pandas as pd
    for prompts in batches:
        out = []
        for p in prompts:
            if len(p) % 13 == 5:
                raise ValueError(REFUSAL)
            labels = re.findall(r"(?m)^Part: (.*)$", p)
            items = [{"message": f"chore({lab.strip()}): update {lab.strip()} ",
                      "reason": " Keeps the files of this group together."} for lab in labels]
            variant = len(p) % 4
            if variant == 3:
                items = items[:-1]
            body = json.dumps(items, ensure_ascii=False)
            if variant == 1:
                body = "```json\n" + body + "\n```"
            elif variant == 2:
                body = "Here you go:\n" + body + "\nHope this helps."
            out.append(body)
        yield pd.Series(out, dtype=object)


# ---------------------------------------------------------------------------
# Model answers from conversations
# ---------------------------------------------------------------------------

def _answer_text(col: str = "text") -> F.Column:
    """The whole turn, JSON-escaped (backslash, quote), newlines as spaces."""
    t = F.col(col)
    t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit('"'), F.lit('\\"'))
    return F.replace(t, F.lit("\n"), F.lit(" "))


def responses_from_conversations(conversations: DataFrame) -> DataFrame:
    """``responses(request_id, raw)``: one object-shaped answer per turn, seven
    shapes by ``request_id % 7``: padded object, fenced, between chatter,
    numeric message, missing reason, no JSON, one-element array."""
    rid = (F.col("conv_id") * 10 + F.col("turn")).cast("long")
    t = _answer_text()
    v = rid % 7
    lit = F.lit
    raw = (F.when(v == 0, F.concat(lit('{"message": "  '), t, lit('  ", "reason": "'), t, lit('"}')))
           .when(v == 1, F.concat(lit('```json\n{"message": "'), t, lit('", "reason": "because"}\n```')))
           .when(v == 2, F.concat(lit('Here is the answer:\n{"message": "'), t,
                                  lit('", "reason": "why"}\nDone.')))
           .when(v == 3, F.concat(lit('{"message": 42, "reason": "'), t, lit('"}')))
           .when(v == 4, F.concat(lit('{"message": "'), t, lit('"}')))
           .when(v == 5, t)
           .otherwise(F.concat(lit('[{"message": "'), t, lit('", "reason": "r"}]'))))
    return conversations.select(rid.alias("request_id"), raw.alias("raw"))


def array_responses_from_conversations(conversations: DataFrame) -> DataFrame:
    """``(request_id, expected, raw)``: array-shaped answers, five shapes by
    ``request_id % 5``; ``expected`` (2 or 3) is the group count asked for."""
    rid = (F.col("conv_id") * 10 + F.col("turn")).cast("long")
    t = _answer_text()
    lit = F.lit

    def item(k: str) -> F.Column:
        return F.concat(lit('{"message": "'), t, lit('", "reason": "r' + k + '"}'))
    two = F.concat(lit("["), item("1"), lit(", "), item("2"), lit("]"))
    three = F.concat(lit("["), item("1"), lit(", "), item("2"), lit(", "), item("3"), lit("]"))
    v = rid % 5
    raw = (F.when(v == 0, two)
           .when(v == 1, F.concat(lit("```json\n"), three, lit("\n```")))
           .when(v == 2, F.concat(lit("Result:\n"), two, lit("\nend")))
           .when(v == 3, F.concat(lit("["), item("1"), lit(', {"message": "x"}]')))
           .otherwise(F.concat(two, lit("  trailing"))))
    return conversations.select(rid.alias("request_id"), (2 + rid % 2).cast("int").alias("expected"),
                                raw.alias("raw"))


CHUNK_CHARS = 7


def chunks_from_responses(responses: DataFrame) -> DataFrame:
    """``response_chunks(request_id, idx, chunk, is_last)``: answers cut into
    7-character pieces (a stream would deliver them in any order)."""
    pieces = F.regexp_extract_all(F.col("raw"), F.lit(r"(?s).{1,%d}" % CHUNK_CHARS), 0)
    exploded = responses.select("request_id", F.size(pieces).alias("_n"),
                                F.posexplode_outer(pieces).alias("idx", "chunk")).filter(F.col("idx").isNotNull())
    return exploded.select("request_id", "idx", "chunk", (F.col("idx") == F.col("_n") - 1).alias("is_last"))


# ---------------------------------------------------------------------------
# UI events from the events table
# ---------------------------------------------------------------------------

def candidate_events_from_events(events: DataFrame) -> DataFrame:
    """``candidate_events``: one UI action per event row; session = user_id,
    seq = event_id.  signup -> add, click -> toggle, view -> edit; error ->
    loading, models, error (every 8th+2 with empty text), prompt or history by
    ``event_id``; purchase -> committed, staged files, settings, reorder, one
    setting or done by ``event_id % 6``."""
    from ..operators import candidates as C
    eid, et = F.col("event_id"), F.col("event_type")
    cid = F.concat(F.lit("c"), (eid % 5).cast("string"))
    typ = (F.when(et == "signup", F.lit(C.ADD)).when(et == "click", F.lit(C.TOGGLE))
           .when(et == "view", F.lit(C.UPDATE_MESSAGE))
           .when(et == "error", F.when(eid % 4 == 0, F.lit(C.SET_LOADING)).when(eid % 4 == 1, F.lit(C.SET_MODELS))
                 .when(eid % 8 == 3, F.lit(C.SET_PROMPT)).when(eid % 8 == 7, F.lit(C.SET_COMMIT_HISTORY))
                 .otherwise(F.lit(C.ERROR)))
           .when(et == "purchase", _pick([C.COMMITTED, C.SET_STAGED_FILES, C.SET_SETTINGS, C.REORDER, C.UPDATE_SETTING,
                                          C.DONE], eid % 6)))
    message = (F.when(et == "signup", F.concat(F.lit("add "), eid.cast("string")))
               .when(et == "view", F.col("props"))
               .when(typ == C.SET_PROMPT, F.concat(F.lit("prompt "), eid.cast("string")))
               .when(typ == C.ERROR,
                     F.when(eid % 8 == 2, F.lit("")).otherwise(F.concat(F.lit("failed "), eid.cast("string")))))

    def files_of(name):
        return F.array(F.concat(F.lit("src/"), name, F.lit(".ts")),
                       F.concat(F.lit("tests/"), name, F.lit("_"), eid.cast("string"), F.lit(".ts")))

    def entry(offset: int, checked: bool):
        name = F.concat(F.lit("c"), ((eid + offset) % 5).cast("string"))
        return F.struct(name.alias("id"), F.concat(F.lit("r"), eid.cast("string")).alias("message"),
                        F.concat(F.lit("moved "), eid.cast("string")).alias("reason"), files_of(name).alias("files"),
                        F.lit(checked).alias("checked"))
    payload = F.when((et == "purchase") & (eid % 6 == 3), F.array(entry(1, True), entry(2, False)))
    return events.select(
        F.col("user_id").alias("session"), eid.alias("seq"), typ.alias("type"),
        F.when(et.isin("signup", "click", "view"), cid).alias("id"), message.alias("message"),
        F.when(et == "signup", F.concat(F.lit("why "), eid.cast("string"))).alias("reason"),
        F.when(et == "signup", files_of(cid))
        .when(typ == C.SET_STAGED_FILES, F.array(F.concat(F.lit("staged/"), eid.cast("string")))).alias("files"),
        F.when((et == "purchase") & (eid % 6 == 0), (eid % 3 + 1).cast("int")).alias("count"),
        payload.alias("payload"),
        F.when(typ == C.SET_SETTINGS, F.struct((eid % 4 == 0).alias("conventional"),
                                               _pick(["en", "zh", "auto"], eid % 3).alias("language"))).alias("settings"),
        F.when(typ == C.UPDATE_SETTING, _pick([C.SETTING_CONVENTIONAL, C.SETTING_LANGUAGE], eid % 4 / 2)).alias("key"),
        F.when(typ == C.UPDATE_SETTING, F.when(eid % 4 < 2, _pick(["true", "false"], eid % 8 / 4))
               .otherwise(_pick(["zh", "fr"], eid % 8 / 4))).alias("value"),
        F.when(typ == C.SET_MODELS, F.array(F.struct(F.concat(F.lit("model-"), eid.cast("string")).alias("id"),
                                                     F.lit("Model").alias("name")))).alias("models"),
        F.when(typ == C.SET_COMMIT_HISTORY, F.array(F.md5(eid.cast("string")))).alias("history"))


def edits_from_events(events: DataFrame) -> DataFrame:
    """Saved message edits (session, id, seq, message): one per view event;
    every third is blank (ignored by the edit rule)."""
    eid = F.col("event_id")
    return events.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("session"), F.concat(F.lit("c"), (eid % 5).cast("string")).alias("id"),
        eid.alias("seq"),
        F.when(eid % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  edit "), eid.cast("string"),
                                                             F.lit(" "))).alias("message"))
