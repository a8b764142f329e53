"""History jobs: recent commits per repo (OP-16/17), author-language
detection (OP-18), per-snapshot language resolution (OP-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import js_trim, non_ascii_units, utf16_length

# History entries per repo, log rows scanned for the language,
# subjects used for it, and the non-ASCII share above which the language is zh.
HISTORY_LIMIT = 20
LANG_SCAN = 50
LANG_SUBJECTS = 20
ZH_SHARE = (1, 5)  # > 1/5 of the UTF-16 units


def newest_first(df: DataFrame, n: int, keys=("repo",)) -> DataFrame:
    """Keep the first ``n`` rows per key in log order (ties by hash)."""
    w = Window.partitionBy(*keys).orderBy("log_pos", "hash")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_commits(log: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """OP-16 + OP-17: the newest ``n`` non-merge entries per repo, projected
    for display (8-character hash, 16-character date).

    Merges are filtered *before* the limit.  ``row_number() <= n`` becomes a
    WindowGroupLimit: each map task keeps at most n rows per repo before the
    shuffle, so even a repo holding a third of the log ships n rows per task.
    """
    recent = newest_first(log.filter(~F.col("is_merge"))
                          .select("repo", "log_pos", "hash", "subject", "author", "date"), n)
    return recent.select(
        "repo", "log_pos", F.substring("hash", 1, 8).alias("short_hash"),
        F.col("subject").alias("message"), "author", F.substring("date", 1, 16).alias("short_date"))


def history_counts(recent: DataFrame) -> DataFrame:
    """OP-37 (history part): entries shown per repo (at most the limit)."""
    return recent.groupBy("repo").agg(F.count(F.lit(1)).alias("history_entries"))


def subject_stats(log: DataFrame, users: DataFrame) -> DataFrame:
    """OP-18 core: per repo, the subjects the language rule looks at.

    Steps in the original order: non-merge -> newest 50 -> author is the
    current user (log e-mail lower-cased; user e-mail trimmed and
    lower-cased) -> first 20.  Returns subjects, text length and non-ASCII
    count, both in UTF-16 units.  Both limits are WindowGroupLimits.
    """
    scanned = newest_first(log.filter(~F.col("is_merge"))
                           .select("repo", "log_pos", "hash", "email", "subject"), LANG_SCAN)
    me = users.select("repo", F.lower(js_trim("email")).alias("_user"))
    mine = newest_first(scanned.join(me, "repo").filter(F.lower("email") == F.col("_user")),
                        LANG_SUBJECTS)
    return (mine.groupBy("repo")
            .agg(F.count(F.lit(1)).alias("subjects"),
                 F.sum(utf16_length("subject")).cast("long").alias("text_len"),
                 F.sum(non_ascii_units("subject")).cast("long").alias("non_ascii")))


def detect_language(log: DataFrame, users: DataFrame) -> DataFrame:
    """OP-18: ``zh`` when non-ASCII units are more than a fifth of all units
    of the user's subjects, else ``en`` (no user, no subject, empty text).

    The comparison is integer (5 * non_ascii > text_len), so an empty text
    never divides by zero.  Repos come from ``users`` by a left join, so a
    repo without matching commits still gets ``en``.
    """
    stats = subject_stats(log, users)
    num, den = ZH_SHARE
    out = users.select("repo").distinct().join(stats, "repo", "left")
    subjects = F.coalesce("subjects", F.lit(0)).cast("long")
    text_len = F.coalesce("text_len", F.lit(0)).cast("long")
    non_ascii = F.coalesce("non_ascii", F.lit(0)).cast("long")
    lang = F.when((text_len > 0) & (non_ascii * den > text_len * num), F.lit("zh")).otherwise(F.lit("en"))
    return out.select("repo", subjects.alias("subjects"), text_len.alias("text_len"),
                      non_ascii.alias("non_ascii"), lang.alias("language"))


def resolve_language(settings: DataFrame, detected: DataFrame,
                     lang_col: str = "language") -> DataFrame:
    """OP-19: ``auto`` takes the repo's detected language (``en`` when none);
    ``prompt_language`` is what prompts render: ``zh`` or else ``en``."""
    det = detected.select("repo", F.col("language").alias("_detected"))
    lang = F.col(lang_col)
    resolved = F.when(lang == "auto", F.coalesce("_detected", F.lit("en"))).otherwise(lang)
    out = settings.join(det, "repo", "left").withColumn("resolved_language", resolved).drop("_detected")
    return out.withColumn("prompt_language",
                          F.when(F.col("resolved_language") == "zh", F.lit("zh")).otherwise(F.lit("en")))
