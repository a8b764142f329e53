"""Line jobs: classify diff lines (OP-07) and number them (OP-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import starts_with_any

# Line starts that mark a meta line (checked after ``@@``).
META_PREFIXES = ["diff ", "index ", "--- ", "+++ ", "new file", "deleted file", "similarity",
                 "rename", "\\"]
# A hunk header that resets the counters; searched anywhere in the line.
HUNK_RANGE = r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"

FILE_KEYS = ["repo", "commit_id", "file_seq"]


def line_kind(raw: Column) -> Column:
    return (F.when(raw.startswith("@@"), F.lit("hunk"))
            .when(starts_with_any(raw, META_PREFIXES), F.lit("meta"))
            .when(raw.startswith("+"), F.lit("add"))
            .when(raw.startswith("-"), F.lit("del"))
            .otherwise(F.lit("ctx")))


def _with_kinds(lines: DataFrame, keep: list[str]) -> DataFrame:
    raw = F.col("raw")
    kind = line_kind(raw)
    sign = (F.when(kind == "add", F.lit("+")).when(kind == "del", F.lit("-"))
            .when(kind == "ctx", F.lit(" ")).otherwise(F.lit("")))
    text = (F.when(kind.isin("add", "del"), F.substr(raw, F.lit(2)))
            .when((kind == "ctx") & raw.startswith(" "), F.substr(raw, F.lit(2)))
            .otherwise(raw))
    return lines.select(*keep, "pos", kind.alias("kind"), sign.alias("sign"), text.alias("text"), "raw")


def explode_lines(file_changes: DataFrame, keys: list[str] | None = None,
                  diff_col: str = "diff") -> DataFrame:
    """OP-07: one row per line: pos, kind, sign, text, raw.

    The split is on ``\n`` only, so the empty piece after a final newline is
    a ``ctx`` row; an empty diff gives no rows.
    """
    keys = keys or FILE_KEYS
    src = file_changes.filter(F.length(diff_col) > 0).select(*keys, diff_col)
    lines = (src.select(*keys, F.posexplode_outer(F.split(diff_col, "\n", -1)).alias("pos", "raw"))
             .filter(F.col("pos").isNotNull()))
    return _with_kinds(lines, keys)


def number_lines(file_changes: DataFrame, keys: list[str] | None = None, diff_col: str = "diff",
                 width: int = 1 << 15) -> DataFrame:
    """OP-07 + OP-08: one row per line with its old/new line numbers.

    Counters start at 0/0; a hunk line matching ``@@ -a[,n] +b[,m] @@`` sets
    them to a/b (one that does not match is kept but resets nothing); ``add``
    shows and advances new, ``del`` old, ``ctx`` both; the shown value is the
    one before the increment.

    One pass: a file's lines are cut into buckets of ``width`` lines inside
    its row, and each bucket gets the counters it starts with, folded over
    the buckets before it.  The compact bucket rows are then dealt out by
    (file, bucket), so that an enormous file is exploded and numbered by many
    tasks, and one window per bucket numbers its lines.
    """
    keys = keys or FILE_KEYS
    counters = "struct<o:bigint,n:bigint>"

    def after(state: Column, raw: Column) -> Column:
        kind = line_kind(raw)
        valid = (kind == "hunk") & raw.rlike(HUNK_RANGE)
        number = lambda i: F.coalesce(F.regexp_extract(raw, HUNK_RANGE, i).try_cast("long"), F.lit(0))
        return F.struct(
            F.when(valid, number(1)).otherwise(state["o"] + kind.isin("ctx", "del").cast("long")).alias("o"),
            F.when(valid, number(2)).otherwise(state["n"] + kind.isin("ctx", "add").cast("long")).alias("n"))

    zero = F.struct(F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("n"))
    lines = F.split(diff_col, "\n", -1)
    buckets = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / width).cast("int")),
                          lambda b: F.slice("_lines", b * width + 1, F.lit(width)))
    # The counters before each bucket: one fold over the file, bucket by bucket.
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{counters}>").alias("before"))
    carried = F.aggregate("_buckets", start, lambda acc, part: F.struct(
        F.aggregate(part, acc["at"], after).alias("at"),
        F.concat(acc["before"], F.array(acc["at"])).alias("before")))
    # A file of one bucket starts at zero: nothing is folded.
    before = F.when(F.size("_buckets") == 1, F.array(zero).cast(f"array<{counters}>")).otherwise(carried["before"])
    cut = (file_changes.filter(F.length(diff_col) > 0).select(*keys, lines.alias("_lines"))
           .select(*keys, F.explode_outer(F.array(F.struct(buckets.alias("b")))).alias("_s"))
           .select(*keys, F.col("_s.b").alias("_buckets"))
           .select(*keys, F.posexplode_outer(F.arrays_zip(F.col("_buckets").alias("part"), before.alias("start")))
                   .alias("_b", "_z")))
    dealt = cut.filter(F.col("_b").isNotNull()).repartition(*keys, "_b")
    rows = (dealt.select(*keys, "_b", F.col("_z.start").alias("_start"), F.posexplode("_z.part").alias("_i", "raw"))
            .withColumn("pos", (F.col("_b") * width + F.col("_i")).cast("int")))
    numbered = _with_kinds(rows, [*keys, "_b", "_start"])
    raw, kind = F.col("raw"), F.col("kind")
    valid = (kind == "hunk") & raw.rlike(HUNK_RANGE)
    w = Window.partitionBy(*keys, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumns({"_o": kind.isin("ctx", "del").cast("long"), "_n": kind.isin("ctx", "add").cast("long")})
    numbered = numbered.withColumns({"_co": F.sum("_o").over(w), "_cn": F.sum("_n").over(w)})
    number = lambda i: F.coalesce(F.regexp_extract(raw, HUNK_RANGE, i).try_cast("long"), F.lit(0))
    hunk = F.struct(number(1).alias("a"), number(2).alias("b"),
                    F.col("_co").alias("co"), F.col("_cn").alias("cn"))
    numbered = numbered.withColumn("_h", F.last(F.when(valid, hunk), ignorenulls=True).over(w))
    # From the last hunk of the bucket, else from where the bucket starts.
    old_n = F.when(F.col("_h").isNotNull(), F.col("_h.a") - F.col("_h.co")).otherwise(F.col("_start.o")) + \
        F.col("_co") - F.col("_o")
    new_n = F.when(F.col("_h").isNotNull(), F.col("_h.b") - F.col("_h.cn")).otherwise(F.col("_start.n")) + \
        F.col("_cn") - F.col("_n")
    return numbered.select(*keys, "pos", "kind", "sign", "text", "raw",
                           F.when(kind.isin("ctx", "del"), old_n).alias("old_n"),
                           F.when(kind.isin("ctx", "add"), new_n).alias("new_n"))
