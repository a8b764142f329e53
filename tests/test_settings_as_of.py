"""Options as they were at a request (versions and as-of join) and the
prompts of a snapshot stream under them."""

import random

from commitscope.operators import settings
from commitscope.sources.fixtures import load_commits, requests_from_commits
from commitscope.streaming import jobs

SF = "/root/testdata/sf0.001"
UPDATES = "repo string, seq bigint, conventional boolean, language string"
REQUESTS = ("repo string, commit_id bigint, seq bigint, kind string, conventional boolean, language string, "
            "model string, prompt string")


def replay(updates, requests):
    """Step by step: all events in order of ``seq``, updates first."""
    out = []
    steps = [(s, 0, r, (c, lang)) for r, s, c, lang in updates if r is not None and s is not None]
    steps += [(q[2], 1, q[0], q) for q in requests]
    state = {}
    for _, rank, repo, row in sorted(steps, key=lambda x: (x[0], x[1])):
        kept = state.setdefault(repo, [None, None, None])
        if rank == 0:
            kept[:2] = [old if new is None else new for old, new in zip(kept, row)]
            continue
        _, cid, seq, kind, conv, lang, model, prompt = row
        if kind == "regenerate" and lang != "auto":
            kept[2] = lang or None
        session = kept[2]
        if kind == "regenerate":
            got = (conv, lang, model, prompt)
        else:
            got = (True if kept[0] is None else kept[0], session or kept[1] or "en", None, None)
        out.append((repo, cid, seq, kind, *got, session))
    return out


def events(rng, n):
    repos = ["hot"] * 8 + ["a", "b"]
    updates = [(rng.choice(repos), s, rng.choice([None, True, False]), rng.choice([None, "zh", "en", "auto"]))
               for s in rng.sample(range(n), n // 3)]
    requests = []
    for s in range(n):
        own = rng.random() < 0.4
        requests.append((rng.choice(repos), s, s, "regenerate" if own else "ready",
                         rng.choice([True, False]) if own else None,
                         rng.choice(["zh", "en", "fr", "auto", "", None]) if own else None,
                         "m" if own else None, rng.choice([None, "p"]) if own else None))
    return updates, requests


COLS = ("repo", "commit_id", "seq", "kind", "conventional", "language", "model", "prompt", "session_language")


def test_as_of_equals_replay(spark):
    for seed in range(2):
        updates, requests = events(random.Random(seed), 120)
        updates += [(None, 4, True, "zh"), ("a", None, True, "zh")]
        up, req = spark.createDataFrame(updates, UPDATES), spark.createDataFrame(requests, REQUESTS)
        timeline = settings.option_timeline(up, req, width=16)
        got = settings.settings_as_of(req, timeline, width=16).select(*COLS).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, replay(updates, requests)))


def test_versions_meet_and_only_the_last_is_open(spark):
    updates, requests = events(random.Random(9), 90)
    rows = settings.option_timeline(spark.createDataFrame(updates, UPDATES), spark.createDataFrame(requests, REQUESTS),
                                    width=8).orderBy("repo", "valid_from").collect()
    for this, after in zip(rows, rows[1:]):
        assert this["valid_to"] == (after["valid_from"] if after["repo"] == this["repo"] else None)
    assert rows[-1]["valid_to"] is None


def test_empty_tables_and_requests_before_any_version(spark):
    none, no_requests = spark.createDataFrame([], UPDATES), spark.createDataFrame([], REQUESTS)
    timeline = settings.option_timeline(none, no_requests)
    assert timeline.count() == 0 and settings.settings_as_of(no_requests, timeline).count() == 0
    early = spark.createDataFrame([("a", 1, 1, "ready", None, None, None, None)], REQUESTS)
    late = settings.option_timeline(spark.createDataFrame([("a", 5, False, "zh")], UPDATES), no_requests)
    got = settings.settings_as_of(early, late).first()
    assert (got["conventional"], got["language"]) == (True, "en")


def test_late_snapshots_get_the_options_of_their_time(spark, tmp_path):
    """Newest snapshots first, one file per micro-batch: the same prompts as
    the batch job makes of all snapshots."""
    commits = load_commits(spark, SF)
    requests = requests_from_commits(commits)
    updates = spark.createDataFrame([(r[0], r[1], r[1] % 2 == 0, "zh" if r[1] % 3 else "en") for r in
                                     requests.select("repo", "seq").collect() if r[1] % 4 == 0], UPDATES)
    base = str(tmp_path)
    timeline = jobs.staged(settings.option_timeline(updates, requests), f"{base}/timeline")
    languages = spark.createDataFrame([], "repo string, language string")
    recent = spark.createDataFrame([], "repo string, history string")
    whole = jobs.snapshot_prompts(commits, requests, timeline, languages, recent).collect()
    cut = sorted(r["commit_id"] for r in whole)[len(whole) // 2]
    for part in (commits.filter(commits.commit_id > cut), commits.filter(commits.commit_id <= cut)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(commits.schema).parquet(f"{base}/in")
        jobs.run_prompt_stream(src, requests_from_commits, f"{base}/timeline", languages, recent, base)
    got = spark.read.parquet(f"{base}/prompts")
    assert got.select("batch_id").distinct().count() == 2
    assert sorted(map(tuple, got.drop("batch_id").collect())) == sorted(map(tuple, whole))
