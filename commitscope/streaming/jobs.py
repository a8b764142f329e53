"""Structured Streaming jobs.

* Snapshot stream (OP-40): parsing, classification, churn and prompts are
  in-row expressions, so the batch functions apply to a streaming DataFrame
  unchanged; a snapshot is one input row and never spans micro-batches.
* Stateful folds (OP-25 chunks, OP-30 session status, OP-40 newest snapshot
  per repo) are streaming aggregates in ``update`` mode.  Each micro-batch's
  updated rows are appended with their batch id through ``foreachBatch``
  (idempotent: a replayed batch id overwrites its own folder), and readers
  take the newest version per key.  State stays in the checkpoint, so a
  restarted query (or a lost executor) resumes where it stopped.

Sources are files (``readStream`` over a folder) with
``trigger(availableNow=True)``: no sockets, no servers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keep_where
from ..operators import candidates as cstate
from ..operators import churn, diffs, history, paths, prompts, settings
from ..session import ensure_checkpoint_dir
from . import keyed


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/commitscope-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back, so micro-batches don't
    compute it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_churn_stream(commits: DataFrame) -> DataFrame:
    """OP-40 stateless part: snapshots -> classified file changes with churn."""
    fc = diffs.split_file_changes(commits)
    return churn.file_churn(paths.classify_paths(fc)).drop("diff")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet") -> None:
    """Run a streaming DataFrame over everything available, then stop."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()


def run_versioned(agg: DataFrame, out: str, checkpoint: str) -> None:
    """Run an update-mode aggregate; every micro-batch's changed rows land in
    ``out/batch_id=<n>`` (overwritten on replay, so exactly once)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_versions(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row per key across the versioned micro-batch outputs."""
    df = spark.read.parquet(out)
    value_cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    newest = F.max_by(F.struct(*value_cols), F.col("batch_id"))
    return df.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


# ---------------------------------------------------------------------------
# Stateful aggregates (streaming DataFrames in, streaming DataFrames out)
# ---------------------------------------------------------------------------

def assemble_stream(chunks: DataFrame) -> DataFrame:
    """OP-25 on a chunk stream.  State is kept for every request, as in the
    original: an answer may be completed at any time."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "chunk")))
    return (chunks.groupBy("request_id")
            .agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("raw"),
                 F.count(F.lit(1)).alias("chunks"),
                 F.max(F.col("is_last").cast("int")).cast("boolean").alias("complete")))


def status_stream(events: DataFrame) -> DataFrame:
    """OP-30 scalar state per session on an event stream (same aggregates
    as the batch job; all combine map-side)."""
    return cstate.session_status(events)


def newest_snapshot_stream(commits: DataFrame) -> DataFrame:
    """OP-40 refresh: the newest snapshot of each repo supersedes the older
    ones (by commit_id)."""
    return (commits.groupBy("repo")
            .agg(F.max_by(F.struct("commit_id", "raw_diff"), F.col("commit_id")).alias("_s"))
            .select("repo", "_s.commit_id", "_s.raw_diff"))


# ---------------------------------------------------------------------------
# Helpers that land a batch table as files and stream it back
# ---------------------------------------------------------------------------

def land_as_stream(spark: SparkSession, df: DataFrame, base: str, batches: int = 4) -> DataFrame:
    """Write ``df`` as parquet files under ``base/in`` and return a stream
    reading that folder (the file source sees each file once) in about
    ``batches`` micro-batches.  There are as many files as the session has
    shuffle partitions, which is sized with the data."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(files).write.mode("overwrite").parquet(f"{base}/in")
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches))
            .parquet(f"{base}/in"))


# ---------------------------------------------------------------------------
# State kept as one table per micro-batch
# ---------------------------------------------------------------------------

def state_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """The newest state under ``path`` written by a batch before ``batch_id``
    (by any, without one); None if there is none.

    Every micro-batch writes the whole state to its own folder, so a batch
    reads one earlier table however many came before, and a replayed batch
    never reads what its first attempt left."""
    if batch_id == 0:
        return None
    versions = spark.read.parquet(path)
    if batch_id is not None:
        versions = versions.filter(F.col("batch_id") < batch_id)
    newest = versions.agg(F.max("batch_id")).first()[0]
    return None if newest is None else versions.filter(F.col("batch_id") == newest).drop("batch_id")


# ---------------------------------------------------------------------------
# OP-30 candidate lists on streams
# ---------------------------------------------------------------------------

def run_fold_stream(events: DataFrame, base: str, idle_ms: int | None = None) -> None:
    """Fold a UI-event stream into candidate lists and status, exactly,
    whatever order events arrive in (:class:`keyed.ListFold`).

    Every micro-batch writes the changes of the sessions it touched to
    ``changes/batch_id=<n>`` (overwritten on replay; the state is versioned by
    batch too, so a retried batch is exact).  Sessions without new events cost
    nothing.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch_id={batch_id}")

    with keyed.rocksdb(events.sparkSession):
        q = (keyed.list_changes(events, idle_ms).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def _changes(spark: SparkSession, base: str, kind: str) -> DataFrame:
    schema = f"{keyed.CHANGES}, batch_id long"
    return spark.read.schema(schema).parquet(f"{base}/changes").filter(F.col("kind") == kind)


def latest_status(spark: SparkSession, base: str) -> DataFrame:
    """The newest status row of every session, with the epoch of its list."""
    values = ["generating", "error", "success_count", "staged_loading", "base_seq", "last_seq", "epoch"]
    newest = F.max_by(F.struct(*values), "batch_id")
    return _changes(spark, base, keyed.STATUS).groupBy("session").agg(newest.alias("_s")).select("session", "_s.*")


def latest_lists(spark: SparkSession, base: str) -> DataFrame:
    """The newest folded list of every session (empty lists give no rows).

    An entry's toggles are those of its id less the ones before it; its
    message is its id's last edit, if that came after it."""
    now = latest_status(spark, base).select("session", "epoch")
    touched = (_changes(spark, base, keyed.TOUCH).groupBy("session", "epoch", "id")
               .agg(F.max_by(F.struct("toggles", "seq", "message"), "batch_id").alias("_t")))
    entries = _changes(spark, base, keyed.ENTRY).join(now, ["session", "epoch"])
    shown = entries.join(touched, ["session", "epoch", "id"], "left").select(
        "session", F.col("seq").alias("entry_seq"), "sub_pos", "id",
        F.when(F.col("_t.seq") > F.col("seq"), F.col("_t.message")).otherwise(F.col("message")).alias("message"),
        "reason", "files",
        (F.col("checked") != ((F.coalesce("_t.toggles", "toggles") - F.col("toggles")) % 2 == 1)).alias("checked"))
    return cstate.list_positions(shown).select("session", "list_pos", "id", "message", "reason", "files", "checked")


def late_events(spark: SparkSession, base: str) -> DataFrame:
    """Events that came for lists whose events an idle timer had dropped."""
    return _changes(spark, base, keyed.LATE).select("session", "seq", "id", "message")


# ---------------------------------------------------------------------------
# OP-40 superseded snapshots
# ---------------------------------------------------------------------------

def snapshot_groups(commits: DataFrame) -> DataFrame:
    """``repo, commit_id, groups``: files, additions and deletions per group
    type of each snapshot, counted inside its row; blank snapshots have no
    group."""
    parsed = diffs.parse_files(commits, keep_blank=True)
    files = F.transform("files", lambda f: F.struct(
        paths.classification(f["path"])["group_type"].alias("group_type"),
        churn.count_sign_lines(f["diff"], "+").alias("additions"),
        churn.count_sign_lines(f["diff"], "-").alias("deletions")))

    def total(rows, field: str):
        return F.aggregate(rows, F.lit(0).cast("long"), lambda n, r: n + r[field])

    def summed(group):
        rows = F.filter("_f", lambda r: r["group_type"] == group)
        return F.struct(group.alias("group_type"), F.size(rows).cast("long").alias("files"),
                        total(rows, "additions").alias("additions"), total(rows, "deletions").alias("deletions"))

    return parsed.select("repo", "commit_id", files.alias("_f")).select(
        "repo", "commit_id", F.transform(F.array_distinct("_f.group_type"), summed).alias("groups"))


def newest_of_batches(snapshots: DataFrame, key: str = "repo", order: str = "commit_id") -> DataFrame:
    """The newest row per key of every Arrow batch: less to shuffle where one
    key has many rows, the same newest row per key."""
    def run(batches):
        for rows in batches:
            yield rows.loc[rows.groupby(key, dropna=False)[order].idxmax()]

    return snapshots.mapInPandas(run, snapshots.schema)


def run_superseding_churn(commits: DataFrame, base: str) -> None:
    """Stream of snapshots -> signed churn rows (:class:`keyed.Supersede`), a
    folder per micro-batch (overwritten on replay)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/signed/batch_id={batch_id}")

    with keyed.rocksdb(commits.sparkSession):
        signed = keyed.superseding(newest_of_batches(snapshot_groups(commits)))
        q = (signed.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_churn(spark: SparkSession, base: str) -> DataFrame:
    """Churn over the newest snapshots only: the sum of the signed rows."""
    rows = spark.read.schema(f"{keyed.SIGNED}, batch_id long").parquet(f"{base}/signed")
    sums = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("files", "additions", "deletions")]
    return rows.groupBy("repo", "group_type").agg(*sums).filter(F.col("files") > 0)


def newest_run_stream(runs: DataFrame, session: str = "repo", generation: str = "generation") -> DataFrame:
    """OP-31 on a run stream: the newest run (and whether it was cancelled)
    per session, as an update-mode aggregate."""
    newest = F.max_by(F.struct(F.col(generation).alias("generation"), F.col("cancelled")), F.col(generation))
    return runs.groupBy(session).agg(newest.alias("_n")).select(session, "_n.generation", "_n.cancelled")


# ---------------------------------------------------------------------------
# OP-40 groups and prompts of a snapshot stream
# ---------------------------------------------------------------------------

def file_groups_stream(commits: DataFrame) -> DataFrame:
    """Snapshots -> file groups; a group never leaves its snapshot's row, so
    the stream keeps no state."""
    return paths.group_files_in_row(diffs.parse_files(commits))


def snapshot_prompts(snapshots: DataFrame, requests: DataFrame, timeline: DataFrame, languages: DataFrame,
                     recent: DataFrame) -> DataFrame:
    """``repo, commit_id, n_groups, model, prompt_text`` of every requested
    snapshot with files, under the options valid at the request's ``seq``.

    ``languages``: repo, language (``auto`` becomes it); ``recent``: repo,
    history.  Options are narrow rows until they meet the snapshots."""
    grouped = paths.with_groups(diffs.parse_files(snapshots))
    options = history.resolve_language(settings.settings_as_of(requests, timeline), languages).select(
        "repo", "commit_id", "conventional", "prompt_language", "prompt", "model")
    asked = keep_where(grouped, F.size("groups") > 0).join(options, ["repo", "commit_id"]).join(recent, "repo", "left")
    return prompts.batch_prompts(asked).select("repo", "commit_id", F.size("groups").alias("n_groups"), "model",
                                               "prompt_text")


def run_prompt_stream(commits: DataFrame, requests_of: Callable[[DataFrame], DataFrame], timeline: str,
                      languages: DataFrame, recent: DataFrame, base: str) -> None:
    """Stream of snapshots -> prompts, a folder per micro-batch (overwritten
    on replay).

    ``requests_of`` gives the requests of a batch of snapshots; ``timeline``
    is the folder of :func:`settings.option_timeline`, which must reach the
    ``seq`` of every snapshot that arrives.  A micro-batch reads it as it is
    then, and of it the versions that overlap its own span of ``seq`` only,
    so a snapshot that comes late still gets the options of its time and the
    cost of a batch doesn't grow with the options' past."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        asked = requests_of(batch)
        first, last = asked.agg(F.min("seq"), F.max("seq")).first()
        versions = batch.sparkSession.read.parquet(timeline).filter(
            (F.col("valid_from") <= F.lit(last)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(first))))
        out = snapshot_prompts(batch, asked, versions, languages, recent)
        out.write.mode("overwrite").parquet(f"{base}/prompts/batch_id={batch_id}")

    q = (commits.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------------------
# Window jobs on streams (row windows are not allowed on streaming plans)
# ---------------------------------------------------------------------------

def run_line_numbers_stream(commits: DataFrame, out: str, checkpoint: str) -> None:
    """OP-07/08 on a snapshot stream: each micro-batch runs the batch
    numbering.  Exact because a snapshot (and so a file) is one input row
    and never spans micro-batches."""
    from ..operators import lines

    def sink(batch: DataFrame, batch_id: int) -> None:
        fc = diffs.split_file_changes(batch)
        numbered = lines.number_lines(fc)
        numbered.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (commits.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_recent_commits_stream(log: DataFrame, base: str, n: int | None = None) -> None:
    """OP-16/17 on a log stream, incrementally: the newest n entries of
    (previous newest n + this batch) are the newest n of everything.  Each
    batch reads the state of the batch before it and writes the whole state,
    at most n rows per repository."""
    n = n or history.HISTORY_LIMIT
    spark = log.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        entries = batch.filter(~F.col("is_merge")).select("repo", "log_pos", "hash", "subject", "author", "date")
        before = state_before(spark, f"{base}/recent", batch_id)
        if before is not None:
            entries = entries.unionByName(before)
        history.newest_first(entries, n).write.mode("overwrite").parquet(f"{base}/recent/batch_id={batch_id}")

    q = (log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_recent_commits(spark: SparkSession, base: str) -> DataFrame:
    """Display rows (OP-17) of each repo's newest history list."""
    return state_before(spark, f"{base}/recent").select(
        "repo", "log_pos", F.substring("hash", 1, 8).alias("short_hash"), F.col("subject").alias("message"), "author",
        F.substring("date", 1, 16).alias("short_date"))
