"""Properties from the test strategy, checked on the corpus derived from the
smallest driver tables."""

from pyspark.sql import functions as F

from commitscope import catalog
from commitscope.operators import candidates as C
from commitscope.operators import churn, diffs, lines, paths
from commitscope.sources.fixtures import load_commits

SF = "/root/testdata/sf0.001"


def test_group_sizes_sum_to_file_count(spark):
    parsed = diffs.parse_files(load_commits(spark, SF))
    grouped = paths.with_groups(parsed)
    bad = (grouped.join(parsed, ["repo", "commit_id"])
           .select(F.aggregate(F.transform("groups", lambda g: F.size(g["files"])), F.lit(0), lambda a, b: a + b)
                   .alias("in_groups"), F.size("files").alias("files"))
           .filter(F.col("in_groups") != F.col("files")))
    assert bad.count() == 0


def test_churn_counts_bounded_by_line_kinds(spark):
    fc = diffs.split_file_changes(load_commits(spark, SF))
    counted = churn.file_churn(fc).select("repo", "commit_id", "file_seq", "additions", "deletions")
    kinds = (lines.explode_lines(fc).groupBy("repo", "commit_id", "file_seq")
             .agg(F.count_if(F.col("kind") == "add").alias("adds"), F.count_if(F.col("kind") == "del").alias("dels")))
    bad = counted.join(kinds, ["repo", "commit_id", "file_seq"]).filter(
        (F.col("additions") > F.col("adds")) | (F.col("deletions") > F.col("dels")))
    assert bad.count() == 0


def test_selected_and_unselected_partition_the_host_list(spark):
    host, selection, _ = catalog._selection_inputs(spark, SF)
    sel = C.selected(host, selection, None, ["session"]).select("session", "candidate_id")
    rest = host.join(selection, ["session", "candidate_id"], "left_anti").select("session", "candidate_id")
    assert sel.intersect(rest).count() == 0
    assert sel.unionByName(rest).distinct().count() == host.select("session", "candidate_id").distinct().count()


def test_line_numbers_independent_of_bucket_width(spark):
    fc = diffs.split_file_changes(load_commits(spark, SF))
    cols = ["repo", "commit_id", "file_seq", "pos", "old_n", "new_n"]
    small = lines.number_lines(fc, width=3).select(*cols)
    big = lines.number_lines(fc).select(*cols)
    assert small.exceptAll(big).count() == 0 and big.exceptAll(small).count() == 0


def test_session_language_independent_of_bucket_width(spark):
    from commitscope.operators import settings
    from commitscope.sources.fixtures import option_updates_from_nation, requests_from_commits, table
    reqs = requests_from_commits(load_commits(spark, SF))
    stored = settings.stored_settings(option_updates_from_nation(table(spark, SF, "nation")))
    a = settings.resolve_settings(reqs, stored, width=2)
    b = settings.resolve_settings(reqs, stored)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
