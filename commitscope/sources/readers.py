"""Sources and sinks: diff corpora (OP-01), commit logs (OP-02), tables (OP-03)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.js import JS_WS_CHARS, is_blank, js_trim_end
from ..operators.diffs import blank_snapshots, non_blank

RECORD_SEP = "\u001f"  # git --format %x1f
COMMIT_SCHEMA = "repo STRING, commit_id BIGINT, raw_diff STRING"


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: str = COMMIT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """OP-01: scan a diff corpus; return (non-blank commits, ``no_changes``
    report with the blank texts).

    ``parquet``/``json``/``orc`` read rows of ``schema`` (column pruning and
    filter push-down apply).  ``text`` reads one snapshot per file with
    ``wholetext``: repo = the file's folder below the first part of ``path``
    without a wildcard, commit_id = a hash of the file's whole path below it,
    so a tree of ``git diff --cached`` dumps is a corpus.
    """
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True)
        df = (raw.select(_below(path, F.input_file_name()).alias("_below"), F.col("value").alias("raw_diff"))
              .select(F.regexp_replace("_below", "/?[^/]*$", "").alias("repo"),
                      F.xxhash64("_below").alias("commit_id"), "raw_diff"))
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    return non_blank(df), blank_snapshots(df, keep_diff=True)


def _below(path: str, file: Column) -> Column:
    """A file's path below the first part of ``path`` without a wildcard."""
    plain = path.split("://")[-1].removeprefix("file:")
    fixed = re.split(r"[*?\[{]", plain)[0]
    root = fixed.rstrip("/") if fixed == plain else fixed.rpartition("/")[0]
    return F.substring_index(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), root + "/", -1)


def read_commits_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                        schema: str = COMMIT_SCHEMA) -> DataFrame:
    """OP-01 as a stream: new files under ``path`` become new snapshots, blank
    ones with ``status`` ``no_changes`` (NULL otherwise), for the sink to
    report or split off."""
    df = spark.readStream.schema(schema).format(fmt).load(path)
    return df.withColumn("status", F.when(is_blank(F.col("raw_diff")), F.lit("no_changes")))


# ---------------------------------------------------------------------------
# OP-02: commit logs
# ---------------------------------------------------------------------------

def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """One git-log output per file; repo = the file's path below the first
    part of ``path`` without a wildcard, without its extension.

    The whole output is trimmed and split on ``\\n``; ``log_pos`` is the line
    index (0 = newest, git order).  Returns (repo, log_pos, line).

    A log is read by as many tasks as it has file splits.  A line's place
    within its split is its row number in the task less that of the split's
    first line, and a prefix over the splits' line counts (one small row a
    split) gives where each begins; lines are neither sorted nor shuffled by
    file.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    full = ~is_blank("line")
    splits = raw.groupBy("_file", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"),
        F.min(F.when(full, F.col("_row"))).alias("_from"), F.max(F.when(full, F.col("_row"))).alias("_to"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    begin = F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")  # row -> place in the file
    placed = splits.select("_file", "_start", begin.alias("_shift"),
                           F.min(F.col("_from") + begin).over(whole).alias("_from"),
                           F.max(F.col("_to") + begin).over(whole).alias("_to"))
    at = F.col("_row") + F.col("_shift")
    first, last = F.coalesce("_from", F.lit(0)), F.coalesce("_to", F.lit(0))  # a blank log is one empty line
    lines = raw.join(placed, ["_file", "_start"]).withColumn("_at", at).filter(F.col("_at").between(first, last))
    text = F.when(F.col("_at") == first, F.call_function("ltrim", F.lit(JS_WS_CHARS), F.col("line"))).otherwise(F.col("line"))
    return lines.select(F.regexp_replace(_below(path, F.col("_file")), r"\.[^./]*\z", "").alias("repo"),
                        (F.col("_at") - first).cast("long").alias("log_pos"),
                        F.when(F.col("_at") == last, js_trim_end(text)).otherwise(text).alias("line"))


def log_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """OP-02, record layout, one pass: every record with ``status`` ``ok`` or
    ``rejected`` (fewer than four fields; its fields are NULL), so a sink can
    split good and bad ones without reading the logs twice."""
    keys = [c for c in lines.columns if c != line_col]
    fields = F.split(F.col(line_col), RECORD_SEP, -1)
    ok = F.size("_f") >= 4
    return (lines.filter(~is_blank(F.col(line_col)) | (F.col("log_pos") > 0)).withColumn("_f", fields)
            .select(*keys, line_col, F.when(ok, "ok").otherwise("rejected").alias("status"),
                    *[F.when(ok, F.get("_f", F.lit(i))).alias(c)
                      for i, c in enumerate(("hash", "subject", "author", "date"))]))


def parse_log_records(lines: DataFrame, line_col: str = "line",
                      strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """OP-02, record layout ``hash %x1f subject %x1f author %x1f date``.

    Only the first four fields are used.  A line with fewer than four fields
    goes to the rejects table.  ``strict=True`` reproduces the original
    all-or-nothing rule: one bad record empties its repo's whole history.
    Blank outputs (a single empty line) give no entries.
    """
    keys = [c for c in lines.columns if c != line_col]
    records = log_records(lines, line_col)
    good = records.filter("status = 'ok'").select(*keys, "hash", "subject", "author", "date")
    bad = records.filter("status = 'rejected'").select(*keys, F.col(line_col).alias("line"),
                                                       F.lit("fewer than 4 fields").alias("reason"))
    if strict:
        bad_repos = bad.select("repo").distinct()
        good = good.join(bad_repos, "repo", "left_anti")
    return good, bad


def parse_author_subject(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """OP-02, tab layout ``email \\t subject``: split at the first tab only;
    a line without a tab is dropped."""
    line = F.col(line_col)
    tab = F.instr(line, "\t")
    keys = [c for c in lines.columns if c != line_col]
    return (lines.filter(tab > 0)
            .select(*keys, F.substring(line, F.lit(1), tab - 1).alias("email"),
                    F.substr(line, tab + 1).alias("subject")))


# ---------------------------------------------------------------------------
# OP-03: sinks
# ---------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "append", fmt: str = "parquet") -> None:
    """Write one row per item.  Partition columns should be low-cardinality
    (e.g. repo buckets, a date), never the snapshot id."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def upsert_table(df: DataFrame, path: str, keys: list[str], newest: str | None = None, buckets: int = 64) -> None:
    """Write one row per ``keys``: rows whose key is there already are
    replaced, so the same write twice leaves the table as after the first.

    The table is partitioned by a hash of the keys into ``buckets`` (the same
    number in every write); only the buckets that ``df`` touches are written
    again, by a dynamic partition overwrite that removes their old files when
    it commits.  Of rows with one key in ``df`` the one with the greatest
    ``newest`` stays (any of them without it).  Rows with a NULL in a key
    count as equal there.
    """
    spark = df.sparkSession
    columns = df.columns
    if newest is None:
        rows = df.dropDuplicates(keys)
    else:
        rest = [c for c in columns if c not in keys]
        rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(*keys, "_r.*").select(*columns)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # Read twice (which buckets, and what is written), so computed once.
    rows = rows.withColumn("_bucket", bucket).checkpoint()
    df.limit(0).withColumn("_bucket", bucket).write.mode("ignore").partitionBy("_bucket").parquet(path)
    touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # ``buckets`` rows
    there = spark.read.schema(rows.schema).parquet(path).filter(F.col("_bucket").isin(touched))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_bucket", *keys]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    kept = there.alias("a").join(rows.select("_bucket", *keys).alias("b"), condition, "left_anti")
    (kept.unionByName(rows).repartition("_bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that :func:`upsert_table` wrote."""
    return spark.read.parquet(path).drop("_bucket")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 fmt: str = "parquet", trigger_once: bool = True):
    """Streaming sink: append rows as they are produced (file sinks are
    exactly-once through the checkpoint)."""
    w = df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start(path)
