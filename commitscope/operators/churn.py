"""Churn jobs: per-file additions/deletions (OP-09), totals (OP-10), add
ratio and 10-segment bar (OP-11), status letter (OP-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import round_half_up

BAR_SEGMENTS = 10


def count_occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` (literal replace, no regex)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def count_sign_lines(diff, sign: str) -> Column:
    """Lines (split on ``\\n`` only) that start with ``sign`` but not with
    ``sign`` three times: line starts are the text start and every ``\\n``,
    so the count is occurrences of ``\\n+`` minus those of ``\\n+++``,
    plus the first line.  Literal replaces only: no array, no regex."""
    diff = F.col(diff) if isinstance(diff, str) else diff
    triple = sign * 3
    first = F.when(diff.startswith(sign) & ~diff.startswith(triple), F.lit(1)).otherwise(F.lit(0))
    return (count_occurrences(diff, "\n" + sign) - count_occurrences(diff, "\n" + triple) + first).cast("long")


def file_churn(file_changes: DataFrame, diff_col: str = "diff") -> DataFrame:
    """OP-09: add ``additions`` and ``deletions`` to every file row (narrow)."""
    return file_changes.withColumns({
        "additions": count_sign_lines(diff_col, "+"),
        "deletions": count_sign_lines(diff_col, "-"),
    })


def churn_totals(file_churn_df: DataFrame, keys: list[str]) -> DataFrame:
    """OP-10: files, additions, deletions per key set.

    Plain ``groupBy().agg(sum, count)``: partial aggregation combines map-side,
    so only one small row per key and task is shuffled.
    """
    return (file_churn_df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("files"),
                 F.sum("additions").cast("long").alias("additions"),
                 F.sum("deletions").cast("long").alias("deletions")))


def add_ratio(additions: Column, deletions: Column) -> Column:
    total = additions + deletions
    return F.when(total > 0, additions / total).otherwise(F.lit(0.0))


def churn_bars(file_churn_df: DataFrame) -> DataFrame:
    """OP-11: ``add_ratio`` (0 when nothing changed), ``filled`` = round half
    up of ratio*10, and the bar as text: ``+`` per filled segment, ``-`` for
    the rest, or ten ``.`` (empty) when the file has no counted lines."""
    a, d = F.col("additions"), F.col("deletions")
    ratio = add_ratio(a, d)
    filled = round_half_up(ratio * BAR_SEGMENTS).cast("int")
    bar = F.when(a + d > 0, F.concat(F.repeat(F.lit("+"), filled),
                                     F.repeat(F.lit("-"), BAR_SEGMENTS - filled))) \
        .otherwise(F.repeat(F.lit("."), BAR_SEGMENTS))
    return file_churn_df.withColumns({"add_ratio": ratio, "filled": filled, "bar": bar})


def status_letter(change_type) -> Column:
    """OP-12: A / D / R, anything else M."""
    t = F.col(change_type) if isinstance(change_type, str) else change_type
    return (F.when(t == "added", F.lit("A")).when(t == "deleted", F.lit("D"))
            .when(t == "renamed", F.lit("R")).otherwise(F.lit("M")))
