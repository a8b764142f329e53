from pyspark.sql import functions as F

from commitscope.functions import js_trim, replace_first, utf16_length
from commitscope.operators import churn, diffs, lines
from commitscope.sources.readers import read_commits


def test_js_trim_unicode_space(spark):
    df = spark.createDataFrame([("﻿  x y　\n",), (" ",)], "s string")
    assert [r[0] for r in df.select(js_trim("s")).collect()] == ["x y", ""]


def test_utf16_length_counts_astral_twice(spark):
    df = spark.createDataFrame([("a😀",)], "s string")
    assert df.select(utf16_length("s")).first()[0] == 3


def test_replace_first_only_first(spark):
    df = spark.createDataFrame([("a-b-c",)], "s string")
    assert df.select(replace_first(F.col("s"), "-", "+")).first()[0] == "a+b-c"


def _commit(spark, raw, cid=1):
    return spark.createDataFrame([("r", cid, raw)], "repo string, commit_id bigint, raw_diff string")


def _files(spark, raw):
    return [r.asDict() for r in diffs.split_file_changes(_commit(spark, raw)).orderBy("file_seq").collect()]


def test_blank_snapshot_reported(spark):
    c = _commit(spark, "  \u00a0\ufeff\n")
    assert diffs.split_file_changes(c).count() == 0
    assert [r.status for r in diffs.blank_snapshots(c).collect()] == ["no_changes"]


def test_text_before_header_skipped_and_paths(spark):
    raw = ("junk line\n"
           "diff --git a/a b/c.txt b/a b/c.txt\n--- a/x\n+++ b/x\n"
           "diff --git \"a/\\303\\251\" \"b/\\303\\251\"\n"
           "diff --git a/old b/new\nsimilarity index 90%\nrename from old\nrename to new\n"
           "diff --git a/n b/n\nnew file mode 100644\nrename from q\n"
           "diff --git a/m b/m\nold mode 100644\nnew mode 100755\n"
           "diff --git a/crlf b/crlf\r\n+x\n")
    got = _files(spark, raw)
    assert [(f["path"], f["change_type"]) for f in got] == [
        ("c.txt", "modified"), ("new", "renamed"), ("n", "added"), ("m", "modified")]
    assert [f["file_seq"] for f in got] == [0, 1, 2, 3]


def test_segments_reassemble_input(spark):
    raw = "diff --git a/x b/x\n+1\n-2\n diff --git inside\ndiff --git a/y b/y\n+3\n"
    got = _files(spark, raw)
    assert "".join(f["diff"] for f in got) == raw


def test_lookup_last_duplicate_wins(spark):
    raw = "diff --git a/p b/p\n+first\ndiff --git a/p b/p\n+second\n"
    fc = diffs.split_file_changes(_commit(spark, raw))
    wanted = spark.createDataFrame([("r", 1, "p"), ("r", 1, "missing")], "repo string, commit_id bigint, path string")
    out = diffs.lookup_diffs(fc, wanted).collect()
    assert len(out) == 1 and out[0].diff.endswith("+second\n")


def _lines(spark, diff):
    fc = spark.createDataFrame([("r", 1, 0, diff)], "repo string, commit_id bigint, file_seq int, diff string")
    dl = lines.number_lines(fc)
    return [(r.kind, r.old_n, r.new_n, r.text) for r in dl.orderBy("pos").collect()]


def test_line_kinds_and_numbers(spark):
    diff = ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3 +3 @@\n ctx\n-del\n+add\n--- x\n\\ No newline\n"
            "@@ -10,2 +20,2 @@\n c\n@@@ -1,2 -1,2 +1,3 @@@\n+a\n")
    got = _lines(spark, diff)
    assert got[3] == ("hunk", None, None, "@@ -3 +3 @@")
    assert got[4] == ("ctx", 3, 3, "ctx")
    assert got[5] == ("del", 4, None, "del")
    assert got[6] == ("add", None, 4, "add")
    assert got[7][0] == "meta"            # '-- x' deleted line looks like '--- '
    assert got[8][0] == "meta"            # backslash line
    assert got[10] == ("ctx", 10, 20, "c")  # second hunk resets
    assert got[11][0] == "hunk"           # combined hunk: no reset
    assert got[12] == ("add", None, 21, "a")
    assert got[-1] == ("ctx", 11, 22, "")  # empty piece after the final newline


def test_churn_counts_skip_triple_signs(spark):
    fc = spark.createDataFrame([("+++ b/x\n+ok\n+++x\n++y\n---\n-d\n",)], "diff string")
    r = churn.file_churn(fc).first()
    assert (r.additions, r.deletions) == (2, 1)
    # the line classifier still calls '++y' an add (the two rules differ by design)
    fc2 = spark.createDataFrame([("r", 1, 0, "++y")], "repo string, commit_id bigint, file_seq int, diff string")
    assert lines.explode_lines(fc2).first().kind == "add"


def test_bars_round_half_up(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (1, 1)], "additions long, deletions long")
    got = [(r.filled, r.bar) for r in churn.churn_bars(df).collect()]
    assert got == [(3, "+++-------"), (0, ".........."), (5, "+++++-----")]


def test_read_commits_text(spark, tmp_path):
    d = tmp_path / "repo-x"
    d.mkdir()
    (d / "snap1.diff").write_text("diff --git a/a b/a\n+1\n")
    (d / "snap2.diff").write_text(" \n")
    good, blank = read_commits(spark, str(tmp_path / "*" / "*.diff"), fmt="text")
    assert good.count() == 1 and blank.count() == 1
    assert good.first().repo == "repo-x"
