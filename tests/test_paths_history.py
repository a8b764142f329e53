from commitscope.operators import history, paths, settings

GOLDEN = {
    "package.json": "deps", "a/yarn.lock": "deps", "foo.lock": "misc", "requirements.txt": "deps",
    "pnpm-lock.yaml": "deps", "Cargo.toml": "deps", "other.toml": "config", "src/a.test.ts": "test",
    "src/a.spec.jsx": "test", "tests/x.py": "test", "test": "test", "a/e2e/b.go": "test",
    "latest/x.go": "source:latest", "src/test_x.py": "source:src", "vite.config.ts": "config",
    "x.rc.js": "config", ".env": "config", "a/.envrc": "config", "b.YAML": "config",
    "x.editorconfig": "config", ".editorconfig": "misc", "tsconfig.base.json": "config",
    ".prettierrc": "config", "README.MD": "docs", "docs/a.png": "docs", "doc/x.c": "docs",
    "src/docs/x.c": "source:src", "src/docs.txt": "docs", "lib/core.py": "source:lib", "main.go": "misc",
    "a.b/c": "source:a.b", ".eslintrc.json": "config",
}


def test_classification_golden(spark):
    df = spark.createDataFrame([(p,) for p in GOLDEN], "path string")
    got = {r.path: r.group_key for r in paths.classify_paths(df).collect()}
    assert got == GOLDEN


def test_every_path_one_group_and_labels(spark):
    df = spark.createDataFrame([("src/a.ts",), ("x",)], "path string")
    got = {r.path: (r.group_type, r.label) for r in paths.classify_paths(df).collect()}
    assert got == {"src/a.ts": ("source", "source: src/"), "x": ("misc", "misc")}


def test_groups_first_seen_order(spark):
    files = [(0, "b/x.py", "modified", "d0"), (1, "README.md", "added", "d1"), (2, "b/y.py", "deleted", "d2")]
    df = spark.createDataFrame([("r", 1, files)],
                               "repo string, commit_id bigint, files array<struct<file_seq:int,path:string,"
                               "change_type:string,diff:string>>")
    got = [(r.group_ord, r.group_key, [f.path for f in r.files])
           for r in paths.group_files_in_row(df).orderBy("group_ord").collect()]
    assert got == [(0, "source:b", ["b/x.py", "b/y.py"]), (1, "docs", ["README.md"])]
    # same answer from the one-row-per-file form
    fc = spark.createDataFrame([("r", 1, *f) for f in files],
                               "repo string, commit_id bigint, file_seq int, path string, change_type string, diff string")
    got2 = [(r.group_ord, r.group_key) for r in paths.group_file_changes(fc).orderBy("group_ord").collect()]
    assert got2 == [(0, "source:b"), (1, "docs")]


def test_relativize_first_occurrence_anywhere(spark):
    df = spark.createDataFrame([("/x/r/a/x/r/b", "/x/r"), ("C:\\r\\a", "C:\\r")], "p string, root string")
    got = [r.rel_path for r in paths.relativize(df, "p", "root").collect()]
    assert got == ["a/x/r/b", "C:/r/a"]


def _log(spark, rows):
    return spark.createDataFrame(rows, "repo string, log_pos long, hash string, subject string, author string, "
                                       "email string, date string, is_merge boolean")


def test_recent_commits_display(spark):
    log = _log(spark, [("r", i, f"{i:040x}", f"s{i}", "a", "e", "2024-03-05 14:07:33 +0100", i == 0)
                       for i in range(25)])
    got = history.recent_commits(log).orderBy("log_pos").collect()
    assert len(got) == 20 and got[0].log_pos == 1            # merge filtered before the limit
    assert len(got[0].short_hash) == 8 and got[0].short_date == "2024-03-05 14:07"


def test_language_rules(spark):
    users = spark.createDataFrame([("r1", " Me@X.org "), ("r2", "me@x.org"), ("r3", "none@x.org"),
                                   ("r4", "me@x.org")], "repo string, email string")
    rows = [
        ("r1", 0, "h0", "中bcd" + "e" * 0, "a", "ME@x.org", "d", False),   # 1/4 > 0.2 -> zh
        ("r2", 0, "h1", "中bcde", "a", "me@x.org", "d", False),            # exactly 0.2 -> en
        ("r4", 0, "h2", "😀abcdefgh", "a", "me@x.org", "d", False),        # 2/10 (emoji = 2 units) -> en
    ]
    got = {r.repo: r.language for r in history.detect_language(_log(spark, rows), users).collect()}
    assert got == {"r1": "zh", "r2": "en", "r3": "en", "r4": "en"}


def test_session_language_auto_keeps_previous(spark):
    reqs = spark.createDataFrame([
        ("r", 1, "regenerate", True, "zh", None, None),
        ("r", 2, "regenerate", True, "auto", None, None),
        ("r", 3, "ready", None, None, None, None),
    ], "repo string, seq long, kind string, conventional boolean, language string, model string, prompt string")
    stored = spark.createDataFrame([("r", None, "en")], "repo string, stored_conventional boolean, stored_language string")
    got = {r.seq: (r.language, r.conventional) for r in settings.resolve_settings(reqs, stored).collect()}
    assert got == {1: ("zh", True), 2: ("auto", True), 3: ("zh", True)}


def test_partial_updates_keep_untouched_keys(spark):
    ups = spark.createDataFrame([("r", 1, False, "zh"), ("r", 2, None, "en"), ("r", 3, True, None)],
                                "repo string, seq long, conventional boolean, language string")
    r = settings.stored_settings(ups).first()
    assert (r.stored_conventional, r.stored_language) == (True, "en")
