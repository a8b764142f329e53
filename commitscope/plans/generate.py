"""OP-39: the whole generation job.

commits -> files (in row) -> groups (in row) -> options/history join ->
model choice -> batch prompt -> caller's model function (mapInArrow) ->
checkpoint -> strict parse -> one outcome row per snapshot -> candidates and
errors.

Every snapshot flows through one lineage: blank ones parse to an empty file
list, and rows without a prompt pass through the Python stage untouched, so
the corpus is scanned once and the model is called once per snapshot.  The
answers (with status and file lists; no prompts, no diffs) are checkpointed
to the shared checkpoint folder before they are parsed, and the outcomes
before they are split into candidates and errors.  So a task has one Python
worker at a time (the model function's or the JSON validator's, not both),
candidates and errors read the same outcomes, and a lost executor never
re-runs a model call that already succeeded.

Shuffles: the per-snapshot options join (AQE broadcasts it when the measured
size is small), the per-repo history (one row per repo) and the
model-catalogue aggregate.  Groups never leave their snapshot row, so
candidates need no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.js import is_blank
from ..operators import candidates, diffs, inference, paths, prompts, responses
from ..operators.ledger import AnswerLedger
from ..session import ensure_checkpoint_dir

NO_CHANGES = "no_changes"
NO_GROUPS = "could not analyse the staged changes"


def snapshot_outcomes(commits: DataFrame, context: Callable[[DataFrame], DataFrame], fn, models: DataFrame | None = None,
                      ledger: AnswerLedger | None = None) -> DataFrame:
    """One row per snapshot: repo, commit_id, error (NULL when fine),
    items (parsed answer), group_files.  The answers are written (checkpointed,
    or with their prompts where a ``ledger`` keeps them), the parse is not."""
    keys = ["repo", "commit_id"]
    ensure_checkpoint_dir(commits.sparkSession)
    parsed = diffs.parse_files(commits.withColumn("_blank", is_blank("raw_diff")), keep_blank=True)
    grouped = paths.with_groups(parsed)
    snap = context(grouped)
    if models is not None:
        snap = inference.assign_model(snap, models)
    else:
        snap = snap.withColumns({"model_id": F.lit(None).cast("string"),
                                 "error": F.lit(None).cast("string")})
    pre_error = (F.when(F.col("_blank"), F.lit(NO_CHANGES))
                 .when(F.size("groups") == 0, F.lit(NO_GROUPS))
                 .otherwise(F.col("error")))
    staged = prompts.batch_prompts(snap.withColumn("_pre", pre_error))
    staged = staged.select(
        *keys, "model_id", "_pre", F.size("groups").alias("n_groups"),
        F.when(F.col("_pre").isNull(), F.col("prompt_text")).alias("prompt_text"),
        F.transform("groups", lambda g: F.transform(g["files"], lambda f: f["path"])).alias("group_files"))
    if ledger is None:
        answers = inference.infer(staged, fn, keys=keys + ["_pre", "n_groups", "group_files"]).checkpoint()
    else:
        answers = ledger.ask(staged.checkpoint(), fn)
    parsed_answers = responses.parse_array(answers, "n_groups")
    error = F.coalesce(F.col("_pre"), F.col("infer_error"), F.col("error"))
    return parsed_answers.select(*keys, error.alias("error"),
                                 F.when(error.isNull(), F.col("items")).alias("items"), "group_files")


def run_generation(commits: DataFrame, context: Callable[[DataFrame], DataFrame], fn, models: DataFrame | None = None,
                   runs: DataFrame | None = None, generation: str = "commit_id",
                   ledger: AnswerLedger | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (candidates, errors).

    With ``runs`` (repo, ``generation``, cancelled) only the snapshots of each
    repo's newest run are asked about, and none where that run was cancelled.
    With a ``ledger`` equal prompts are asked once, and a run that broke asks
    only what has no answer yet.

    ``context`` adds to each snapshot row (repo, commit_id, ...) the columns
    conventional, prompt_language, prompt, history[, model, catalog_id].  ``errors`` holds
    blank snapshots (``no_changes``), snapshots without a file group, model
    choice failures, inference failures and unparsable answers.
    """
    ensure_checkpoint_dir(commits.sparkSession)
    if runs is not None:
        commits = candidates.latest_generation(commits, runs, "repo", generation)
    outcome = snapshot_outcomes(commits, context, fn, models, ledger).checkpoint()
    keys = ["repo", "commit_id"]
    cands = responses.build_candidates_in_row(outcome.filter(F.col("error").isNull()), keys)
    errors = outcome.filter(F.col("error").isNotNull()).select(*keys, "error")
    return cands, errors
