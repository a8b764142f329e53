from pyspark.sql import functions as F

from commitscope.sources import readers
from commitscope.streaming import jobs


def test_log_text_records_and_strict(spark, tmp_path):
    sep = readers.RECORD_SEP
    (tmp_path / "repo-a.log").write_text(
        f"\n  h1{sep}fix: a{sep}Ann{sep}2024-03-05 14:07:33 +0100\nh2{sep}feat: b{sep}Bob\n")
    (tmp_path / "repo-b.log").write_text(f"h3{sep}docs: c{sep}Cy{sep}2024-01-01 00:00:00 +0000{sep}x\n")
    lines = readers.read_log_text(spark, str(tmp_path / "*.log"))
    good, bad = readers.parse_log_records(lines)
    assert sorted((r.repo, r.log_pos, r.hash, r.date[:10]) for r in good.collect()) == [
        ("repo-a", 0, "h1", "2024-03-05"), ("repo-b", 0, "h3", "2024-01-01")]
    assert [(r.repo, r.log_pos) for r in bad.collect()] == [("repo-a", 1)]
    strict_good, _ = readers.parse_log_records(lines, strict=True)
    assert [r.repo for r in strict_good.collect()] == ["repo-b"]     # one bad record empties repo-a


def test_tab_layout_first_tab_only(spark):
    df = spark.createDataFrame([("r", 0, "a@x\tsub\twith tab"), ("r", 1, "no tab here")],
                               "repo string, log_pos long, line string")
    got = [(r.email, r.subject) for r in readers.parse_author_subject(df).collect()]
    assert got == [("a@x", "sub\twith tab")]


def test_write_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "repo string, n int")
    readers.write_table(df, str(tmp_path / "t"), partition_by=["repo"])
    readers.write_table(df, str(tmp_path / "t"), partition_by=["repo"])   # append
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_newest_run_stream(spark, tmp_path):
    runs = spark.createDataFrame([("r", 1, False), ("r", 3, True), ("s", 2, False)],
                                 "repo string, generation long, cancelled boolean")
    base = str(tmp_path / "runs")
    src = jobs.land_as_stream(spark, runs, base, batches=2)
    jobs.run_versioned(jobs.newest_run_stream(src), f"{base}/out", f"{base}/ckpt")
    got = {r.repo: (r.generation, r.cancelled) for r in jobs.latest_versions(spark, f"{base}/out", ["repo"]).collect()}
    assert got == {"r": (3, True), "s": (2, False)}


def test_incremental_stream_fold_matches_batch(spark, tmp_path):
    from commitscope import catalog
    from commitscope.operators import candidates as C
    events = catalog._events(spark, "/root/testdata/sf0.001")
    base = str(tmp_path / "fold")
    bounds = [r[0] for r in events.selectExpr("percentile(seq, array(0.25, 0.5, 0.75)) AS p").first()]
    edges = [-1] + [int(b) for b in bounds] + [1 << 62]
    for lo, hi in zip(edges, edges[1:]):           # files land in seq order: the incremental path
        events.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1) \
            .write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.run_fold_stream(src, base)
    got = jobs.latest_lists(spark, base).select("session", "list_pos", "id", "message", "checked")
    want = C.list_positions(C.fold_candidates(events)).select("session", "list_pos", "id", "message", "checked")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    st = jobs.latest_status(spark, base).select("session", "generating", "error", "success_count")
    want_st = C.session_status(events).select("session", "generating", "error", "success_count")
    assert sorted(map(tuple, st.collect())) == sorted(map(tuple, want_st.collect()))


def _forget_last_commit(checkpoint):
    """As if the driver had died between a batch's writes and its commit."""
    import os
    names = [n for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()]
    last = max(names, key=int)
    assert int(last) > 0
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def _stream(spark, df, base):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")


def test_replayed_batches_change_nothing(spark, tmp_path):
    from commitscope import catalog
    from commitscope.operators import lines
    from commitscope.sources.fixtures import load_commit_log, load_commits
    sf = "/root/testdata/sf0.001"
    log, events, commits = load_commit_log(spark, sf), catalog._events(spark, sf), load_commits(spark, sf)
    runs = {
        "recent": (log, lambda s, b: jobs.run_recent_commits_stream(s, b), lambda b: jobs.latest_recent_commits(spark, b),
                   catalog.recent_commits(spark, sf)),
        "fold": (events, lambda s, b: jobs.run_fold_stream(s, b), lambda b: catalog._shown(jobs.latest_lists(spark, b)),
                 catalog.state_candidates(spark, sf)),
        "lines": (commits, lambda s, b: jobs.run_line_numbers_stream(s, f"{b}/out", f"{b}/ckpt"),
                  lambda b: spark.read.parquet(f"{b}/out").drop("batch_id", "raw"),
                  lines.number_lines(catalog._file_changes(spark, sf)).drop("raw"))}
    for name, (df, run, read, want) in runs.items():
        base = str(tmp_path / name)
        df.repartition(4).write.parquet(f"{base}/in")
        run(_stream(spark, df, base), base)
        _forget_last_commit(f"{base}/ckpt")
        run(_stream(spark, df, base), base)
        cols = want.columns
        assert sorted(map(str, read(base).select(*cols).collect())) == sorted(map(str, want.collect())), name


def test_state_is_one_table_per_batch(spark, tmp_path):
    path = str(tmp_path / "state")
    assert jobs.state_before(spark, path, 0) is None
    for n in (0, 1, 2):
        spark.createDataFrame([(n, "x")], "v int, w string").write.parquet(f"{path}/batch_id={n}")
    assert jobs.state_before(spark, path).first().v == 2
    assert jobs.state_before(spark, path, 2).collect() == [(1, "x")]


def test_recommended_conf_sizes_partitions():
    from commitscope.session import recommended_conf
    conf = recommended_conf(100 * 1024 ** 4, total_cores=8000)          # 100 TB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 824000     # 819,200 rounded up to whole waves
    small = recommended_conf(10 * 1024 ** 2, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
