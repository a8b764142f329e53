"""Diff jobs: split raw snapshots into file changes (OP-04) with their change
type (OP-05), and look up the diff of a path (OP-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import LT, NOT_LT, is_blank, js_trim_end

# A new file segment starts at every line start followed by the header word.
SEGMENT_BOUNDARY = r"(?<=" + LT + r")(?=diff --git )"
# The header line: greedy first path, so the new path is what follows the
# last " b/" of the line.  Applied to the text before the first newline.
HEADER_LINE = r"\Adiff --git a/" + NOT_LT + r"+ b/(" + NOT_LT + r"+)\z"


def header_line(segment: Column) -> Column:
    return F.substring_index(segment, "\n", 1)


def has_header(segment: Column) -> Column:
    """The segment starts with a valid header that ends in ``\\n``."""
    return (F.instr(segment, "\n") > 0) & header_line(segment).rlike(HEADER_LINE)


def new_path(segment: Column) -> Column:
    return js_trim_end(F.regexp_extract(header_line(segment), HEADER_LINE, 1))


def has_line_starting(text: Column, prefix: str) -> Column:
    """Some line of ``text`` starts with ``prefix`` (JavaScript ``/^prefix/m``:
    a line starts at the beginning or after \\n, \\r, U+2028 or U+2029).
    Plain substring searches, no regex scan."""
    out = text.startswith(prefix)
    for lt in ("\n", "\r", "\u2028", "\u2029"):
        out = out | text.contains(lt + prefix)
    return out


def change_type(segment: Column) -> Column:
    """OP-05: first of added > deleted > renamed, else modified; each test is
    a line-anchored search of the whole segment."""
    return (F.when(has_line_starting(segment, "new file mode"), F.lit("added"))
            .when(has_line_starting(segment, "deleted file mode"), F.lit("deleted"))
            .when(has_line_starting(segment, "rename "), F.lit("renamed"))
            .otherwise(F.lit("modified")))


def non_blank(commits: DataFrame, diff_col: str = "raw_diff") -> DataFrame:
    """OP-01 guard: snapshots whose diff is not blank after ``trim()``."""
    return commits.filter(~is_blank(F.col(diff_col)))


def blank_snapshots(commits: DataFrame, diff_col: str = "raw_diff", keep_diff: bool = False) -> DataFrame:
    """OP-01 report: blank snapshots as ``no_changes`` rows (``keep_diff``:
    with their white space)."""
    keys = [c for c in commits.columns if keep_diff or c != diff_col]
    return (commits.filter(is_blank(F.col(diff_col)))
            .select(*keys, F.lit("no_changes").alias("status")))


def parse_files(commits: DataFrame, diff_col: str = "raw_diff", keep_blank: bool = False) -> DataFrame:
    """OP-04/05 in row: replace the raw diff by an ordered ``files`` array of
    STRUCT<file_seq INT, path, change_type, diff>.

    Segments without a valid header (text before the first header, quoted or
    CRLF headers) are dropped before numbering, so ``file_seq`` is the
    0-based position among the snapshot's real files.  Narrow: no shuffle.
    Blank snapshots are dropped unless ``keep_blank`` (they parse to []).
    """
    segments = F.filter(F.split(F.col(diff_col), SEGMENT_BOUNDARY, -1), has_header)
    files = F.transform(segments, lambda s, i: F.struct(
        i.alias("file_seq"), new_path(s).alias("path"), change_type(s).alias("change_type"),
        s.alias("diff")))
    keys = [c for c in commits.columns if c != diff_col]
    src = commits if keep_blank else non_blank(commits, diff_col)
    return src.select(*keys, files.alias("files"))


def split_file_changes(commits: DataFrame, diff_col: str = "raw_diff") -> DataFrame:
    """OP-04: one row per file change (repo, commit_id, file_seq, path,
    change_type, diff).  ``explode`` of the in-row parse: no shuffle."""
    parsed = parse_files(commits, diff_col)
    keys = [c for c in parsed.columns if c != "files"]
    return (parsed.select(*keys, F.explode_outer("files").alias("f"))
            .filter(F.col("f").isNotNull()).select(*keys, "f.*"))


def lookup_diffs(file_changes: DataFrame, wanted: DataFrame,
                 keys: tuple[str, ...] = ("repo", "commit_id", "path"),
                 order: tuple[str, ...] = ("file_seq",)) -> DataFrame:
    """OP-06: the diff for each wanted key; among duplicates the last one (by
    ``order``) wins, a missing key gives no row.

    The request table is semi-joined first, so only requested files reach
    the aggregate.  It holds the order columns only (a partial row per key
    and task); the diffs are joined to its few rows afterwards and are never
    sorted or aggregated.
    """
    keys, order = list(keys), list(order)
    hits = file_changes.join(wanted.select(*keys).distinct(), keys, "left_semi")
    last = hits.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    place = last.select(*keys, *[F.col("_last")[c].alias(c) for c in order])
    return file_changes.join(place, keys + order).select(*keys, *order, "diff")
